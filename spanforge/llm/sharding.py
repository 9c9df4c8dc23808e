"""Sharding by a Feistel permutation of global row numbers (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.rownum import number_rows

ROUNDS = 4
#: Steps of a cycle walk in one expression. At most min(outside points, this) are walked; with n rows the domain
#: has at most 2 * sqrt(n) + 1 points outside 0..n-1, so a longer walk has a chance of under (2 / sqrt(n)) ** 64.
WALK = 64


def _half(seed: int, k: int, r: Column, m: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), r), F.lit(m))


def _div(x: Column, m: int) -> Column:
    return F.call_function("div", x, F.lit(m).cast("long"))


def _feistel(x: Column, m: int, seed: int) -> Column:
    """One pass over the domain 0 .. m * m - 1, two halves in base m."""
    left, right = _div(x, m), F.pmod(x, F.lit(m))
    for k in range(ROUNDS):
        left, right = right, F.pmod(left + _half(seed, k, right, m), F.lit(m))
    return left * F.lit(m) + right


def permute(row: Column, n: int, seed: int = 17) -> Column:
    """The place of row number `row` in a permutation of 0 .. n-1 that n and seed alone decide.

    Values outside 0 .. n-1 are walked on along their cycle until they fall inside.
    """
    n = max(1, n)
    m = max(1, math.isqrt(n - 1) + 1)
    n_, steps = F.lit(n).cast("long"), min(max(1, m * m - n), WALK)
    first = _feistel(row.cast("long"), m, seed)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        first,
        lambda acc, _: F.when(acc < n_, acc).otherwise(_feistel(acc, m, seed)),
    )
    inside = F.when(walked < n_, walked).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))
    return F.when(first < n_, first).otherwise(inside)


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every document: (doc_id, size, text_crc32, row_no, place, shard, slot).

    Rows are numbered in order of doc_id (null first; equal ids by size and by
    hashes of the text, repeated rows in any order). `place` is the number's image
    under a Feistel permutation of 0 .. n-1; shard = place mod shards and slot =
    place div shards. So the counts of any two shards differ by one at most, slots
    are gapless from 0, and whoever knows n, the seed and a row number can compute
    where it is without the data. size: UTF-8 bytes of the text (null: none) plus 16.
    The law is on rows, so equal texts aren't kept together. Other columns are ignored;
    an empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("__h"),
    )
    numbered, n = number_rows(narrow, [F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("__h")])
    placed = numbered.drop("__h").withColumn("place", permute(F.col("row_no"), n, seed))
    return placed.withColumn("shard", F.pmod(F.col("place"), F.lit(shards)).cast("int")).withColumn(
        "slot", _div(F.col("place"), shards)
    )


def sharded_rows(docs: DataFrame, shards: int = 40, seed: int = 17, doc_id: str = "doc_id") -> DataFrame:
    """docs with shard and slot, for docs whose doc_id is unique and not null; write it partitioned by shard, sorted by slot."""
    where = assign_shards(docs, shards, seed, doc_id).select(F.col("doc_id").alias("__id"), "shard", "slot")
    return docs.join(where, docs[doc_id] == where["__id"]).drop("__id")
