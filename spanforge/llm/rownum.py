"""Gapless global row numbers without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.storage import materialise, partitions


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """df with a column `name` (0, 1, 2, ... in the given order) and the number of rows.

    The rows are dealt out by range and sorted within partitions, so no task
    sees more than its share; each row's place in its partition is written to
    the shared folder, and the offsets come from one count per partition, a
    table with as many rows as there are partitions. Equal keys, however many,
    are told apart by the rows' ids in the scan and so can be split.
    An empty table gives no rows and 0.
    """
    spark = df.sparkSession
    keyed = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(order)], F.monotonically_increasing_id().alias("__uid"))
    keys = [f"__k{i}" for i in range(len(order))] + ["__uid"]
    dealt = (
        keyed.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(*keys)
    )
    dealt = materialise(dealt, "rownum")
    counts = dealt.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = dealt.join(F.broadcast(offsets), "__pid").withColumn(name, F.col("__off") + F.col("__idx"))
    return out.drop("__pid", "__idx", "__off"), dealt.count()
