"""Benchmark decontamination by spaced-seed hashing (DataFrame operations only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.storage import if_small, materialise

#: Masks over consecutive words; a seed is the hash of the words at 1. Any 13 words of which at most 2 differ,
#: and any 8 to 12 words of which at most 1 differs, hold a run that matches one of them.
MASKS = ("111011", "11111")


@dataclass(frozen=True)
class Overlap:
    window: int = 13  # words in a row that must agree
    misses: int = 2  # words that may differ among them
    short: int = 8  # shorter items than `window` count whole, those of so many words with
    short_misses: int = 1  # so many that may differ, those of fewer with none
    evidence: int = 5  # words that must agree for a document to be removed: what is shorter doesn't tell copies from chance
    block_words: int = 200_000  # words of benchmark items that one pass over the documents looks for


#: Words of a document that are looked at together; a row never holds more of a text.
CHUNK = 2048


def _words(text: str) -> Column:
    """A text's words: runs of letters and digits in lower case, so marks and spacing don't matter."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _seed(mask: str, at) -> Column:
    """The seed of a mask; at(i): the hash of the word i places after the seed's first."""
    return F.xxhash64(F.lit(mask), *[at(i) for i, c in enumerate(mask) if c == "1"])


def _probes(docs: DataFrame, o: Overlap, masks: list[str], doc_id: str, text: str) -> DataFrame:
    """(doc_id, k, i, near, seed): each place i of a document of k words, the hashes of the words around it and its seeds."""
    back, ahead = o.window - min(map(len, MASKS)), o.window
    words = docs.select(F.col(doc_id).alias("doc_id"), _words(text).alias("w")).filter(F.col("doc_id").isNotNull())
    each = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(CHUNK))).alias("start"))
    first = F.greatest(F.col("start") - back, F.lit(0))
    parts = each.select("doc_id", F.size("w").alias("k"), "start", first.alias("first"), F.slice("w", first + 1, F.lit(CHUNK + back + ahead)).alias("part"))
    hashed = parts.select("doc_id", "k", "start", "first", F.transform("part", lambda w: F.xxhash64(w)).alias("h"))
    # the outer form keeps Spark from hashing twice to drop texts without words
    places = hashed.select("doc_id", "k", "start", "first", "h", F.posexplode_outer("h").alias("p", "__w"))
    i = F.col("first") + F.col("p")
    places = places.filter((i >= F.col("start")) & (i < F.col("start") + CHUNK))
    near = F.array(*[F.get("h", F.col("p") + x) for x in range(-back, ahead)])
    places = places.select("doc_id", "k", i.alias("i"), near.alias("near"))
    seeds = F.array(*[_seed(m, lambda x: F.get("near", F.lit(back + x))) for m in masks])
    return places.select("doc_id", "k", "i", "near", F.explode(seeds).alias("seed"))


def find_overlaps(docs: DataFrame, items: DataFrame, o: Overlap = Overlap(), doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str | None = None) -> DataFrame:
    """(doc_id, item_id, doc_word, item_words, matched_words): documents that hold a passage of a benchmark item.

    Seeds of items and documents meet by hash; around each hit the two are compared word
    by word. A hit counts if some window of `window` words in a row, which the item
    and the document both hold whole, differs in at most `misses`; an item of `short` to
    `window` - 1 words is one window and may differ in `short_misses`; one with fewer words is found where all of them stand in a row, by a seed over
    all its words where it is shorter than the masks. matched_words: most words of such a window that agree; doc_word: the
    document's word (from 0) at which the first item so found would begin.

    Items go out to all tasks in blocks of `block_words` words at most, of hashes alone; as many passes are made
    as there are blocks. A single longer item is a block of its own. Items with equal words
    are searched for once and all reported. Null ids and texts, empty texts and
    empty tables give no rows; repeated rows of a document or an item count as one. Other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    found = items.select(F.col(item_id).alias("item_id"), F.transform(_words(item_text or text), lambda w: F.xxhash64(w)).alias("words")).filter(
        F.col("item_id").isNotNull() & (F.size("words") > 0)
    )
    least = min(map(len, MASKS))
    total, tiny = found.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.collect_set(F.when(F.size("words") < least, F.size("words")))).first()
    blocks = max(1, -(-int(total) // o.block_words))
    masks = [*MASKS, *["1" * n for n in sorted(tiny)]]
    probes = _probes(docs, o, masks, doc_id, text)
    named = found.select(F.xxhash64("words").alias("items"), "item_id").distinct()  # equal texts by their hash, however many items have one
    classes = found.select("words").distinct().withColumn("items", F.xxhash64("words"))
    classes = classes.withColumn("block", F.pmod("items", F.lit(blocks)))
    hits = None
    for k in range(blocks):
        part = _block(probes, classes.filter(F.col("block") == k).drop("block"), o, masks)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_word int, item_words int, matched_words int")
    each = hits.join(if_small(named), "items").select("doc_id", "item_id", "doc_word", "item_words", "matched_words")
    return each.groupBy("doc_id", "item_id").agg(
        F.min("doc_word").alias("doc_word"), F.max("item_words").alias("item_words"), F.max("matched_words").alias("matched_words")
    )


def _block(probes: DataFrame, classes: DataFrame, o: Overlap, masks: list[str]) -> DataFrame:
    """Verified hits of all documents with one block of item texts."""
    j, m, back = F.col("j"), F.size("words"), o.window - min(map(len, MASKS))
    places = classes.select("words", "items", F.posexplode("words").alias("j", "__w"))
    around = F.array(*[F.get("words", j + x) for x in range(-back, o.window)])
    whole = lambda mask: (m == len(mask)) & (j == 0) if len(mask) < min(map(len, MASKS)) else F.lit(True)
    seeds = F.array_compact(F.array(*[F.when(whole(x), _seed(x, lambda i: F.get("words", j + i))) for x in masks]))
    places = places.select("items", m.alias("m"), "j", around.alias("around"), F.explode(seeds).alias("seed"))
    need = F.when(F.col("m") < o.short, F.col("m")).when(F.col("m") < o.window, F.col("m") - o.short_misses).otherwise(F.lit(o.window - o.misses))
    flags = [F.coalesce((F.get("near", F.lit(x)) == F.get("around", F.lit(x))).cast("int"), F.lit(0)) for x in range(back + o.window)]
    met = probes.join(F.broadcast(places), "seed").filter(sum(flags[1:], flags[0]) >= need)
    met = met.select("doc_id", "items", "k", "i", "j", "m", F.least(F.lit(o.window), F.col("m")).alias("n"), need.alias("need"), F.array(*flags).alias("same"))
    i, n = F.col("i"), F.col("n")
    # windows begin t words before or at the seed; those that leave the item or the document don't count
    counts = F.transform(
        F.sequence(F.lit(-back), F.lit(0)),
        lambda t: F.when(
            (j + t >= 0) & (j + t + n <= F.col("m")) & (i + t >= 0) & (i + t + n <= F.col("k")),
            F.aggregate(F.slice("same", t + back + 1, n), F.lit(0), lambda a, x: a + x),
        ).otherwise(0),
    )
    met = met.select("doc_id", "items", F.greatest(i - j, F.lit(0)).alias("doc_word"), F.col("m").alias("item_words"), F.array_max(counts).alias("matched_words"), "need")
    return met.filter(F.col("matched_words") >= F.col("need")).drop("need")


def remove_contaminated(docs: DataFrame, items: DataFrame, o: Overlap = Overlap(), text: str = "text") -> DataFrame:
    """docs without those that hold a passage of an item, of `evidence` words that agree or more. Each row is judged by its own text, known by its hash, whatever its id; a null or empty text stays."""
    own = F.xxhash64(F.col(text))
    found = find_overlaps(docs.select(own.alias("__key"), F.col(text).alias("__text")), items, o, "__key", text="__text", item_text=text)
    hit = materialise(found.filter(F.col("matched_words") >= o.evidence).select(F.col("doc_id").alias("__hit")).distinct(), "contaminated")
    return docs.join(if_small(hit), own == hit["__hit"], "left_anti")
