"""Running a stream over what a folder holds: arrival in order, a run to the end, what was too late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrive(rows: DataFrame, path: str, time: str, key: str, times: int = 4, files: int = 8, again: Callable[[int], bool] = lambda i: False) -> DataFrame:
    """Writes rows in `times` appends, each a like stretch of time after the last, dealt out by key; the stream that reads them in that order.

    again(i): whether append i is sent twice.
    """
    lo, hi = rows.agg(F.min(time), F.max(time)).first()
    span = (hi - lo) / times if lo is not None else None
    for i in range(times):
        part = rows.limit(0) if lo is None else rows.filter((F.col(time) >= lo + i * span) & ((F.col(time) < lo + (i + 1) * span) if i < times - 1 else F.lit(True)))
        for _ in range(2 if again(i) else 1):
            part.repartition(files, key).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def stretch(rows: DataFrame, time: Column, times: int = 4) -> int:
    """Seconds that one of the appends of `arrive` spans at most, so how much later than others in it a row may be; 1 for an empty table."""
    lo, hi = rows.agg(F.min(F.unix_millis(time)), F.max(F.unix_millis(time))).first()
    return 1 if lo is None else (hi - lo) // (1000 * times) + 2


def start(writer: DataStreamWriter, checkpoint: str, rocks: bool = False) -> StreamingQuery:
    """Starts a stream that ends with what there is now. rocks: its state needs several column families (the session's own setting comes back)."""
    spark = writer._spark
    before = spark.conf.get(STORE, None)
    if rocks:
        spark.conf.set(STORE, ROCKS)
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if rocks:
            spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def finish(writer: DataStreamWriter, checkpoint: str, rocks: bool = False) -> StreamingQuery:
    """Runs a stream to the end of what there is now; what fails in it is raised."""
    query = start(writer, checkpoint, rocks)
    query.awaitTermination()
    return query


def too_late(query: StreamingQuery) -> int:
    """Rows that a stream left out because they came behind its watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
