"""Stupid-backoff scores of documents from the corpus' own n-gram counts, as relations.

n-grams are rows (document, context, n-gram), dealt out by their context; there both get their counts, and the logarithms go into the document's sum.

A word's score is count(n-gram) / count(context), with the longest n-gram that lies within the document. In its own
corpus every n-gram is seen, so no word goes back to a shorter one but where the document begins, and the sum of
logarithms closes up: contexts are n-grams of the order below, and those scored themselves at the beginning cancel out. With N the highest order,
a document of N words or more adds its N-grams and takes off the (N-1)-grams inside it, from the second to the last but one; a shorter
one adds itself as a whole. So only the two highest orders are counted throughout.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.batches import lean, slices, text_slices
from spanforge.llm.storage import drop, if_small, materialise, partitions
from spanforge.llm.words import _BASE, LOWER, find_words, hash_words, mix, text_bytes, windows

NONE = np.zeros(0, "i8")


@dataclass(frozen=True)
class Model:
    order: int = 3
    alpha: float = 0.4  # what a word loses for each order that its n-gram is too rare for
    sample: int = 64  # one in so many documents shows which n-grams are hot
    salt: int = 64  # places over which a hot n-gram, or the others of a hot context, are dealt out
    rows: int = 1_500_000  # of a partition in which they are counted, about
    turns: int = 2  # parts of all contexts that are counted one after the other: more of them need less disk, but read the texts as often


def words(text: Column) -> Column:
    """A text's words: runs of anything but ASCII white space, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), "")


def grams(hashes: str, m: int) -> Column:
    """Hashes of the n-grams of order m, from those of the words, in order."""
    size = F.greatest(F.size(hashes) - (m - 1), F.lit(0))
    out = F.slice(hashes, F.lit(1), size)
    for k in range(1, m):
        out = F.zip_with(out, F.slice(hashes, F.lit(k + 1), size), lambda x, y: F.xxhash64(x, y))
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("key", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).withColumn("n", F.size("h"))


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and with which of them each text begins."""
    data, at = text_bytes(column)
    found = find_words(data, at)
    return hash_words(LOWER[data], found.starts, found.ends), found.first


def word_count(texts: Column) -> Column:
    """How many words a text has; null has none."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        for column in batches:
            found = [np.diff(find_words(*text_bytes(part)).first) for part in text_slices(column)]
            yield pa.array(np.concatenate([np.zeros(0, "i8"), *found]).astype("i8"))

    return F.arrow_udf(count, "long")(texts)


def contexts(h: np.ndarray, first: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """(doc, g, t, ends, w): every context, the hash g of an n-gram of order m - 1, and that of the n-gram t of order m that it begins, but where it ends the document; w is how often the
    context itself counts in the document's sum: -1 inside, 1 for a document that is no longer, else 0."""
    g, at = windows(h, first, m - 1)
    doc = np.searchsorted(first, at, side="right") - 1
    ends = at + m - 1 >= first[doc + 1]
    following = h[np.minimum(at + m - 1, len(h) - 1)] if len(h) else h
    t = mix(g * _BASE + following)
    begins = at == first[doc]
    return doc, g.view("i8"), t.view("i8"), ends, np.where(ends, np.where(begins, 1, 0), np.where(begins, 0, -1)).astype("i1")


ROWS = "key long, g long, t long, w byte, place int"


def _exploded(docs: DataFrame, m: int, o: Model, turn: int | None = None, hot_t: np.ndarray = NONE, hot_g: np.ndarray = NONE) -> DataFrame:
    """ROWS, one for each context; t is null for a document's last. turn: only contexts of this turn. place: over which hot ones are dealt out."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in slices(batches):
            doc, g, t, ends, w = contexts(*_word_hashes(b.column(b.schema.get_field_index("text"))), m)
            key = b.column(b.schema.get_field_index("key")).to_numpy()[doc]
            own = slice(None) if turn is None else np.flatnonzero(g % o.turns == turn)
            key, g, t, ends, w = key[own], g[own], t[own], ends[own], w[own]
            place = np.where(np.isin(g, hot_g) & ~ends, t % o.salt, 0) if len(hot_g) else np.zeros(len(g), "i8")
            place = np.where((np.isin(t, hot_t) & ~ends) | (np.isin(g, hot_g) & ends), key % o.salt, place) if len(hot_t) or len(hot_g) else place
            for i in range(0, len(g), 1 << 17):
                part = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(g[part]), pa.array(t[part], mask=ends[part]), pa.array(w[part]), pa.array(place[part].astype("i4"))], ["key", "g", "t", "w", "place"])

    return docs.select("key", "text").mapInArrow(explode, ROWS)


def _hot(rows: DataFrame, column: str) -> DataFrame:
    """(g): what holds more than one in 4 * partitions of a sample's rows, so as many at most."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    return counts.filter((F.col("c") * (4 * partitions(rows.sparkSession)) > rows.count()) & (F.col("c") > 8)).select(F.col(column).alias("g"))


def hot_grams(docs: DataFrame, m: int, o: Model) -> DataFrame:
    """(g): n-grams of order m that are hot in a sample of the documents (key, text)."""
    return _hot(_exploded(docs.filter(F.pmod("key", F.lit(o.sample)) == 0), m, o), "t")


HELD = "bucket int, keys array<long>, n array<long>, sums array<double>, kind byte, key long, hot long, c long, w long"
HELD_NAMES = [c.split()[0] for c in HELD.split(", ")]


def _counted(batches: Iterator[pa.RecordBatch], hot_t: np.ndarray, hot_g: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """HELD of a partition of ROWS, in which all rows of a context or n-gram that isn't hot are.

    One row for each bucket of documents: their keys, numbers of rows, and sums of what is counted here; and one for each document and hot
    n-gram (kind 0) or context (1): how often it is there, and how often that counts in the document's sum.
    """
    lean()
    held = list(batches)
    if not held:
        return
    column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held])
    key, g, w = column("key"), column("g"), column("w").astype("i8")
    ends = np.concatenate([b.column("t").is_null().to_numpy(zero_copy_only=False) for b in held])
    t = np.concatenate([pc.fill_null(b.column("t"), 0).to_numpy() for b in held])
    del held
    is_t, is_g = np.isin(t, hot_t) & ~ends, np.isin(g, hot_g)

    def logs(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        new = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))
        out = np.empty(len(x))
        out[order] = np.repeat(np.log10(np.diff(np.append(new, len(x)))), np.diff(np.append(new, len(x))))
        return out

    part = np.where(is_g, 0.0, w * logs(g))
    some = np.flatnonzero(~ends)
    if len(some):
        part[some] += np.where(is_t[some], 0.0, logs(t[some]))
    by = np.lexsort((key, key % buckets))
    at = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
    keys, sizes, sums = key[by][at], np.diff(np.append(at, len(by))), np.add.reduceat(part[by], at)
    cuts = np.searchsorted(keys % buckets, np.arange(buckets + 1)).astype("i4")
    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (keys, sizes.astype("i8"), sums)]
    none = lambda n: [pa.nulls(n, pa.int64())] * 4
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype="i4")), *lists, pa.nulls(buckets, pa.int8()), *none(buckets)], HELD_NAMES)
    for kind, hot, x in ((0, is_t, t), (1, is_g, g)):
        own = np.flatnonzero(hot)
        if len(own):
            by = own[np.lexsort((x[own], key[own]))]
            at = np.flatnonzero(np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (x[by][1:] != x[by][:-1])]))
            n = len(at)
            counts = np.diff(np.append(at, len(by))).astype("i8")
            lists = [pa.nulls(n, pa.list_(kind_)) for kind_ in (pa.int64(), pa.int64(), pa.float64())]
            cols = [pa.array(key[by][at]), pa.array(x[by][at]), pa.array(counts), pa.array(np.add.reduceat(w[by], at) if kind else counts)]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), *lists, pa.array(np.full(n, kind, "i1")), *cols], HELD_NAMES)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rows, part) of the documents of a bucket."""
    lean()
    held = [[b.column(c).flatten().to_numpy() for c in ("keys", "n", "sums")] for b in batches]
    if held:
        key, n, part = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]])) if len(by) else by
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(key[by][at]), pa.array(np.add.reduceat(n[by], at)), pa.array(np.add.reduceat(part[by], at))], ["key", "rows", "part"])


def _sums(docs: DataFrame, m: int, total: int, o: Model) -> DataFrame:
    """(key, rows, part): number of a document's contexts, and the sum of the logarithms of the counts of its n-grams of order m, less those of its inner contexts.

    One exchange does for both orders, as an n-gram lies with its context: there each context gets its count, and each n-gram its. This is done for one part of all contexts after the
    other, o.turns in all, so that no more than such a part is on its way at once, in partitions of about o.rows rows. Hot n-grams are dealt out over o.salt places, and other
    n-grams of hot contexts by themselves; what is hot is counted where it lies and these counts are added up, in a table with a row for each document and hot n-gram or context.
    """
    sample = materialise(_exploded(docs.filter(F.pmod("key", F.lit(o.sample)) == 0), m, o), "sampled")
    hot_t, hot_g = (np.sort(np.array([r["g"] for r in _hot(sample, c).collect()], "i8")) for c in "tg")
    every = None
    parts, buckets = max(partitions(docs.sparkSession), -(-total // (o.turns * o.rows))), max(1, -(-total // (4 * o.rows)))
    for turn in range(o.turns):
        rows = _exploded(docs, m, o, turn, hot_t, hot_g).repartition(parts, "g", "place").drop("place")
        held = materialise(rows.mapInArrow(lambda batches: _counted(batches, hot_t, hot_g, buckets), HELD), "held")
        every = held if every is None else every.unionByName(held)
    sums = every.filter("kind is null").select("bucket", "keys", "n", "sums").repartition(buckets, "bucket").mapInArrow(_merged, "key long, rows long, part double")
    hot = every.filter("kind is not null").select("kind", "key", "hot", "c", "w")
    of = F.broadcast(hot.groupBy("kind", "hot").agg(F.log10(F.sum("c").cast("double")).alias("of")))
    more = hot.join(of, ["kind", "hot"]).groupBy("key").agg(F.sum(F.col("w") * F.col("of")).alias("more"))
    out = materialise(sums.join(more, "key", "left").select("key", "rows", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("part")), "sums")
    drop(sample)
    return out


def _tally(docs: DataFrame, m: int, own: bool) -> DataFrame:
    """(g, c) or, with own, (key, g, c): how often n-grams of order m occur, added up where the texts are before they are sent on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in slices(batches):
            g, at = windows(*(x := _word_hashes(b.column(b.schema.get_field_index("text")))), m)
            key = b.column(b.schema.get_field_index("key")).to_numpy()[np.searchsorted(x[1], at, side="right") - 1] if own else np.zeros(len(g), "i8")
            by = np.lexsort((g, key))
            new = np.ones(len(by), bool)
            new[1:] = (g[by][1:] != g[by][:-1]) | (key[by][1:] != key[by][:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(key[by][at]), pa.array(g[by][at].view("i8")), pa.array(np.diff(np.append(at, len(by))).astype("i8"))], ["key", "g", "c"])

    found = docs.select("key", "text").mapInArrow(count, "key long, g long, c long")
    return found.groupBy(*(["key"] if own else []), "g").agg(F.sum("c").alias("c"))


def _single(docs: DataFrame) -> DataFrame:
    """(key, rows, part): the same for single words, which have no context."""
    counts = _tally(docs, 1, False).select("g", F.log10(F.col("c").cast("double")).alias("of"))
    both = _tally(docs, 1, True).join(if_small(materialise(counts, "counts")), "g")
    return materialise(both.groupBy("key").agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("of")).alias("part")), "sums")


def _of_short(docs: DataFrame, base: DataFrame, m: int) -> DataFrame:
    """(key, part): logarithm of the count of a document's words as one n-gram, for documents of m words."""
    short = docs.join(if_small(materialise(base.filter(F.col("n") == m).select("key").distinct(), "short")), "key", "left_semi")
    own = materialise(_tally(short, m, True).select("key", "g"), "own")
    counts = _tally(docs, m, False).join(if_small(materialise(own.select("g").distinct(), "wanted")), "g", "left_semi")
    return materialise(own.join(counts, "g").select("key", F.log10(F.col("c").cast("double")).alias("part")), "of_short")


def backoff_scores(docs: DataFrame, o: Model = Model(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_score) of every document, by the counts of all of them.

    Words are runs of anything but ASCII white space, A-Z in lower case, told apart by 64-bit hashes. A word's score is
    count(n-gram) / count(context) for the longest n-gram (of o.order words at most) that ends with it and lies within the document; for the
    first word count(word) / number of all words. log_score is the sum of log10 of the scores (0 without words), mean_score that by n_words (null
    without words). Repeated documents count each time and get a row each; rows are known by a hash of id and text. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = materialise(rows.select("key", "doc_id", word_count(F.col("text")).alias("n_words")).withColumn("n", F.col("n_words")), "base")
    total = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, texts = F.col("n"), rows.select("key", "text")
    sums = _sums(texts, o.order, total, o) if o.order > 1 else _single(texts)
    held = base.join(sums, "key", "left")
    # rows of equal id and text are in the sums together: each gets its share
    score = F.coalesce(F.col("part") * (n - max(o.order - 2, 0)) / F.col("rows"), F.lit(0.0))
    for m in range(1, o.order - 1):
        if base.filter(n == m).limit(1).count():
            held = held.join(_of_short(rows.select("key", "text"), base, m).withColumnRenamed("part", f"short{m}"), "key", "left")
            score = score + F.coalesce(F.col(f"short{m}"), F.lit(0.0))
    by_total = n if o.order == 1 else 1  # words whose context is the whole corpus
    log_score = F.when(n > 0, score - math.log10(max(1, total)) * by_total).otherwise(0.0)
    out = held.select("doc_id", "n_words", log_score.alias("log_score"))
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def ngram_counts(docs: DataFrame, o: Model = Model(), text: str = "text") -> DataFrame:
    """(m, g, c): the count tables of all orders, for scoring other documents."""
    each = _hashed(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")))
    out = None
    for m in range(1, o.order + 1):
        one = each.select(F.explode(grams("h", m)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c")).select(F.lit(m).alias("m"), "g", "c")
        out = one if out is None else out.unionByName(one)
    return out


def score_others(docs: DataFrame, counts: DataFrame, o: Model = Model(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_score) of documents that aren't in the corpus, by its count tables.

    A word's longest seen n-gram counts, times o.alpha for each order passed over; a word that was never seen has half a count. Columns and
    words as in `backoff_scores`. Each n-gram is a row, joined with the tables; positions are put together again by document.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("key"))
    rows = materialise(rows.select("key", "doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).withColumn("n", F.size("h")), "hashed")
    parts = [rows.select("key", F.posexplode(grams("h", m)).alias("i", "g")).select("key", F.lit(m).alias("m"), (F.col("i") + m - 1).alias("i"), "g") for m in range(1, o.order + 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = counts.filter("m = 1").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    seen = every.join(counts, ["m", "g"], "left").groupBy("key", "i").agg(F.map_from_entries(F.collect_list(F.struct("m", F.coalesce("c", F.lit(0))))).alias("c"))
    before = F.lag("c").over(Window.partitionBy("key").orderBy("i"))
    at = seen.withColumn("b", before)
    score = F.log10(F.lit(0.5) / max(1, total)) + F.least(F.col("i"), F.lit(o.order - 1)) * F.log10(F.lit(o.alpha))
    for m in range(1, o.order + 1):
        c = F.try_element_at("c", F.lit(m))
        context = F.lit(max(1, total)) if m == 1 else F.try_element_at("b", F.lit(m - 1))
        lost = F.least(F.col("i") + 1, F.lit(o.order)) - m
        score = F.when(c > 0, F.log10(c / context) + lost * F.log10(F.lit(o.alpha))).otherwise(score)
    sums = at.select("key", score.alias("s")).groupBy("key").agg(F.sum("s").alias("s"))
    out = rows.select("key", "doc_id", F.col("n").cast("long").alias("n_words")).join(sums, "key", "left")
    log_score = F.coalesce("s", F.lit(0.0))
    return out.select("doc_id", "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_score"))
