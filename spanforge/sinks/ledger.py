"""A sink that holds each micro-batch once, however often it is fed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """A folder of batches and, beside it, a ledger with an entry for each batch that is whole.

    A batch is written to a folder of its own, in place of whatever a failed attempt left there, and entered only when that has succeeded. So a batch that
    comes again after its entry writes nothing, one that comes again before it is written anew, and readers see neither half of it.
    """

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def _entry(self, spark: SparkSession, batch: int):
        jvm = spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.root}/_ledger/{batch:09d}.json")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Writes a batch if the ledger hasn't it yet; whether it did. For `foreachBatch`."""
        spark = rows.sparkSession
        store, path = self._entry(spark, batch)
        if store.exists(path):
            return False
        rows.write.mode("overwrite").parquet(f"{self.root}/data/batch={batch}")
        out = store.create(path, True)
        out.write(bytearray(json.dumps({"batch": batch}).encode()))
        out.close()
        return True

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows of all batches in the ledger."""
        store, path = self._entry(spark, 0)
        if not store.exists(path.getParent()):
            return spark.createDataFrame([], schema)
        entered = spark.read.schema("batch long").json(f"{self.root}/_ledger")
        held = spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/batch=*")
        return held.join(F.broadcast(entered), "batch", "left_semi").drop("batch")  # one row a trigger


def exactly_once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """A stream without rows whose keys came before, as long as the watermark allows them to come again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
