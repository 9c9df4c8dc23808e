"""Filter interaction audit: what each of some filters removes, keeps and shares with the others, in every order, from packed bitmaps."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.batches import lean, text_slices
from spanforge.llm.storage import if_small, materialise
from spanforge.llm.words import find_words, hash_words, mix, per_doc, text_bytes

LETTERS = "ABCDE"
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in "#$%&*|"]] = True
HOT = 1000  # a text is hot if it is one of 1,000 rows or more, so there are at most 1,000 hot ones


@dataclass(frozen=True)
class Limits:
    words: int = 200  # A fails under so many words
    distinct: int = 50  # B fails where fewer per cent of the words are distinct
    upper: int = 3  # C fails where more per cent of the code points are A-Z


def _fails(column: pa.Array, limits: Limits) -> np.ndarray:
    """Of each text the filters A to D that it fails, as bits 0 to 3. Words of one text are told apart by hashes of 64 bits."""
    data, at = text_bytes(column)
    words = find_words(data, at)
    n, doc = np.diff(words.first), words.doc
    _, one = np.unique(hash_words(data, words.starts, words.ends) ^ mix(doc.astype("u8")), return_index=True)
    distinct = np.bincount(doc[one], minlength=len(n))
    a = n < limits.words
    b = 100 * distinct < limits.distinct * n
    c = 100 * per_doc(UPPER[data], at) > limits.upper * per_doc((data & 0xC0) != 0x80, at)
    d = per_doc(SIGNS[data], at) > 0
    return (a + 2 * b + 4 * c + 8 * d).astype("i4")


def text_failures(texts: Column, limits: Limits = Limits()) -> Column:
    """The filters A to D that each whole text fails, as bits 0 to 3; null is empty."""

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        for column in batches:
            yield pa.array(np.concatenate([np.zeros(0, "i4"), *[_fails(part, limits) for part in text_slices(column)]]))

    return F.arrow_udf(look, "int").asNondeterministic()(texts)  # so that no filter runs it again


def repeats(rows: DataFrame, n_rows: int, key: str = "digest", doc_id: str = "doc_id") -> DataFrame:
    """rows with `repeat`: whether a row with a smaller doc_id has the same key; without doc_id never.

    Each key's smallest doc_id comes from an aggregate, so copies are merged before they are shuffled. Keys that hold a
    thousandth of the rows or more, at most 1,000, are met by broadcast; only the others' rows are dealt out by key.
    """
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(doc_id).alias("__first")).filter("__n > 1")
    groups = materialise(groups.select(F.col(key).alias("__key"), "__first", (F.col("__n") * HOT >= n_rows).alias("__hot")), "groups")
    hot, rare = groups.filter("__hot").select("__key", "__first"), groups.filter("not __hot").select("__key", "__first")
    met = rows[key] == F.col("__key")
    both = rows.join(F.broadcast(hot), met).unionByName(rows.join(F.broadcast(hot), met, "left_anti").join(if_small(rare, of=groups), met, "left"), allowMissingColumns=True)
    return both.withColumn("repeat", F.coalesce(F.col(doc_id) > F.col("__first"), F.lit(False))).select(*rows.columns, "repeat")


def bitmaps(codes: np.ndarray, masks: np.ndarray, filters: int) -> np.ndarray:
    """For each part, subset of filters and kind (all rows, good, toxic) the number of rows that fail none of the subset.

    codes: the parts' numbers, 0, 1, ... without gaps; masks: failed filters as the lowest bits, then good, then toxic. A bitset has a bit
    a row; rows lie in order of part, each part from a new word of 64 bits on, so a part's bitset is a range of words.
    """
    sizes = np.bincount(codes)
    spans = -(-sizes // 64)
    starts = np.concatenate([[0], np.cumsum(spans)[:-1]])
    order = np.argsort(codes, kind="stable")
    bit = np.arange(len(codes)) + np.repeat(64 * starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)

    def packed(rows: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * int(spans.sum()), bool)
        bits[bit] = rows
        return np.packbits(bits, bitorder="little").view("u8")

    fails = [packed((masks[order] >> f) & 1) for f in range(filters)]
    kinds = [packed((masks[order] >> f) & 1) for f in (filters, filters + 1)]
    left = [packed(np.ones(len(codes), bool))]
    for subset in range(1, 1 << filters):
        last = subset.bit_length() - 1
        left.append(left[subset ^ (1 << last)] & ~fails[last])
    return np.array([[np.add.reduceat(np.bitwise_count(bits).astype("i8"), starts) for bits in (x, *(x & k for k in kinds))] for x in left]).transpose(2, 0, 1)


def subset_counts(rows: DataFrame, filters: int, chunk: int = 1 << 20) -> DataFrame:
    """(part, subset, docs, good, toxic): how many rows of a part fail none of the filters in a subset (a number whose bits are filters).

    rows: (part string, mask int), see bitmaps(). Each task builds bitmaps over its own rows, `chunk` at a time, and passes on counts, which are then summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            parts = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
            found = bitmaps(parts.indices.to_numpy(), np.concatenate([h[1] for h in held]), filters)
            n = 1 << filters
            cols = [parts.dictionary.take(pa.array(np.repeat(np.arange(len(found)), n))), pa.array(np.tile(np.arange(n, dtype="i4"), len(found)))]
            return pa.RecordBatch.from_arrays([*cols, *[pa.array(found[:, :, k].reshape(-1)) for k in range(3)]], ["part", "subset", "docs", "good", "toxic"])

        held = []
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).cast(pa.string()), b.column(1).to_numpy()))
            if sum(len(h[1]) for h in held) >= chunk:
                yield flush()
                held = []
        if held:
            yield flush()

    found = rows.select("part", "mask").mapInArrow(count, "part string, subset int, docs long, good long, toxic long")
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])


def every_order(counts: DataFrame, letters: str) -> DataFrame:
    """The report of all orders of the filters, from subset_counts(): see audit()."""
    full = (1 << len(letters)) - 1
    entry = F.sort_array(F.collect_list(F.struct("subset", "docs", "good", "toxic")))
    steps = counts.groupBy("part").agg(entry.alias("c"))
    steps = steps.select("part", "c", F.explode(F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    before = sum((F.when(F.locate(x, F.expr("left(filter_order, step - 1)")) > 0, 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    own = F.element_at(F.create_map(*[v for i, x in enumerate(letters) for v in (F.lit(x), F.lit(1 << i))]), F.expr("substr(filter_order, step, 1)"))
    steps = steps.withColumns({"b": before, "f": own})
    weights = F.array(*[F.lit(math.factorial(k) * math.factorial(len(letters) - 1 - k)) for k in range(len(letters))])
    steps = steps.withColumn("weights", weights)
    removed = "c[b].docs - c[b | f].docs"
    return steps.selectExpr(
        "part", "filter_order", "step", "c[b | f].docs as kept", f"{removed} as removed", f"c[0].docs - c[f].docs - ({removed}) as redundant",
        f"c[{full} ^ f].docs - c[{full}].docs as unique_fails", "c[b].good - c[b | f].good as good_lost", "c[b].toxic - c[b | f].toxic as toxic_lost",
        f"aggregate(filter(sequence(0, {full}), s -> s & f = 0), 0L, (sum, s) -> sum + weights[bit_count(s)] * (c[s].docs - c[s | f].docs)) as shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each filter does at each step of each order, in every part of docs.

    Failures: A: under limits.words words; B: under limits.distinct per cent distinct words; C: over limits.upper per cent capitals A-Z; D: a
    sign of `#$%&*|`; E: the text of a row with a smaller doc_id. Columns: part (null: empty), filter_order (left to right), step (from 1);
    kept (after it), removed (by it), redundant (failing it, but removed before), unique_fails (failing nothing else), good_lost and
    toxic_lost (removed, of quality 1 and toxic 1), shapley (removed, summed over all orders).

    A null text is empty: it fails A, and E where an empty or null one has a smaller doc_id. Each row counts, repeated or not; rows without doc_id
    neither fail E nor have labels. A label counts if any of the document's label rows has it. Other columns don't matter. An empty table gives no rows.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.md5(clean)).alias("digest"), text_failures(F.col(text), limits).alias("fails"))
    rows = materialise(rows, "flagged")
    known = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("__good"), F.max((F.col("toxic") == 1).cast("int")).alias("__toxic"))
    known = materialise(known.filter("__id is not null and (__good = 1 or __toxic = 1)"), "known")
    flagged = repeats(rows, rows.seen["rows"]).join(if_small(known), F.col("doc_id") == F.col("__id"), "left")
    mask = "fails + 16 * cast(repeat as int) + 32 * coalesce(__good, 0) + 64 * coalesce(__toxic, 0) as mask"
    return every_order(subset_counts(flagged.selectExpr("part", mask), len(LETTERS)), LETTERS)
