"""Event-time windows over streams; what comes later than the watermark allows is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, span: Column, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n, value) of each window; in append mode a window comes once, when the watermark has passed its end."""
    grouped = events.withWatermark(time, late).groupBy(span.alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def tumbling(events: DataFrame, keys: list[str], width: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    return windowed(events, F.window(time, width), keys, time, late)


def sliding(events: DataFrame, keys: list[str], width: str, step: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Windows of `width` that begin every `step`; an event is in each that holds it."""
    return windowed(events, F.window(time, width, step), keys, time, late)


def sessions(events: DataFrame, keys: list[str], gap: str | Column, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A key's events less than `gap` apart; gap may depend on the event. A window ends `gap` after its last event."""
    return windowed(events, F.session_window(time, gap), keys, time, late)
