"""Whole tables in one order: ranges of about as many rows, and numbers that run through all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sinks.writers import kept

PART = "__part"


def dealt(rows: DataFrame, order: list[Column], parts: int | None = None, sort: bool = True) -> DataFrame:
    """rows written in ranges of the order, with PART, the number of a row's range; within one they lie sorted. Equal rows are told apart by where they were read, so no key is too frequent."""
    keys = [f"__k{i}" for i in range(len(order) + 1)]
    named = rows.select("*", *[c.alias(k) for c, k in zip([*order, F.monotonically_increasing_id()], keys, strict=True)])
    out = named.repartitionByRange(*([parts] if parts else []), *keys)
    out = out.sortWithinPartitions(*keys) if sort else out
    return kept(out.drop(*keys).withColumn(PART, F.spark_partition_id()), "dealt")


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """rows with their number, from 0, in the ascending order of the whole table, nulls first.

    Each range is numbered where it lies; the ranges' sizes, a row each, say where each begins.
    """
    keys = [f"__o{i}" for i in range(len(order) + 1)]
    keyed = rows.select("*", *[c.alias(k) for c, k in zip([*order, F.monotonically_increasing_id()], keys, strict=True)])
    each = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    place = F.monotonically_increasing_id()  # of a row in its range, below the range's number
    held = kept(each.withColumns({PART: F.shiftright(place, 33).cast("int"), "__place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = held.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    begins = F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over as many rows as there are ranges
    out = held.join(F.broadcast(sizes.select(PART, begins.alias("__begins"))), PART)
    return out.withColumn(name, F.col("__begins") + F.col("__place")).drop(PART, "__begins", "__place")


def share(rows: DataFrame, order: list[Column], workers: int, worker: int | None = None) -> DataFrame:
    """rows with the worker whose turn each is, in the order of the whole table; only one worker's where it is named."""
    out = numbered(rows, order).withColumn("worker", F.pmod("number", F.lit(workers)).cast("long")).drop("number")
    return out if worker is None else out.filter(F.col("worker") == worker)
