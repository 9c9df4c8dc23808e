"""Sampling without a random generator: rows are ordered by a hash of a seed and their key, so any number of tasks agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.tables import small


def keyed(seed: str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))


def per_group(rows: DataFrame, group: str, key: str, most: int, seed: str) -> DataFrame:
    """At most `most` rows of each group."""
    w = Window.partitionBy(group).orderBy(keyed(seed, group, key), key)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def at_rate(rows: DataFrame, group: str, key: str, rate: Column, seed: str) -> DataFrame:
    """Each group at its rate: floor(rate) copies of all rows (numbered by `copy`) and int(n * fraction) rows more. A negative rate is an error."""
    w = Window.partitionBy(group).orderBy(keyed(seed, group, key), key)
    r = F.when(rate < 0, F.raise_error(F.lit("a sampling rate is negative")).cast("double")).otherwise(rate)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    copies = F.floor(r) + (F.row_number().over(w) <= F.floor(F.round(n * (r - F.floor(r)), 9))).cast("long")
    marked = rows.withColumn("__c", copies).filter("__c > 0")
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__c")))).drop("__c")


def quota(rows: DataFrame, group: str, key: str, total: int, seed: str) -> DataFrame:
    """The same number of rows of each group, total div groups; over all rows if that is 0. Only the number of groups comes to the driver."""
    groups = rows.select(group).distinct().count()
    each = total // max(1, groups)
    return per_group(rows, group, key, each, seed) if each else rows.orderBy(keyed(seed, group, key), key).limit(total)


def top_candidates(rows: DataFrame, score: str, expected: DataFrame, k: int) -> DataFrame:
    """(episode_index, frame_index): the k best frames by score and nearness to the expected one, and that one, within the episode."""
    r = rows.join(small(expected), "episode_index")
    w = Window.partitionBy("episode_index").orderBy(score, F.abs(F.col("frame_index") - F.col("expected")), "frame_index")
    best = r.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).select("episode_index", "frame_index", "length")
    some = best.union(expected.select("episode_index", "expected", "length"))
    return some.select("episode_index", F.least(F.greatest(F.col("frame_index"), F.lit(1)), F.col("length") - 1).alias("frame_index")).distinct()
