"""Memory that a session carries from step to step, replayed in batch; `traces` keeps it as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.sequence import memory_chain


def _parts(rows: DataFrame) -> DataFrame:
    """rows with __part: how often the session's memory was reset up to each step."""
    if "reset_memory" not in rows.columns:
        return rows.withColumn("__part", F.lit(0).cast("long"))
    w = Window.partitionBy("episode_index").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__part", F.sum(F.coalesce("reset_memory", F.lit(False)).cast("long")).over(w))


def replay(rows: DataFrame, initial: str) -> DataFrame:
    """(episode_index, sample_id, memory_in, memory_out) of recorded steps; one with reset_memory, if there is such a column, begins with the initial memory again."""
    return memory_chain(_parts(rows), initial, "__part").select("episode_index", "sample_id", "memory_in", "memory_out")
