"""Quality rules: repetition, and divergence from what a language's texts look like."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.batches import lean, slices, text_slices
from spanforge.llm.storage import drop, if_small, materialise
from spanforge.llm.words import _U, LOWER, find_words, hash_words, per_doc, text_bytes, windows

#: Character classes by byte: lower-case, upper-case, digit, space, line feed, sentence mark, symbol, other ASCII, start of a longer character.
CLASSES = 9
CLASS = np.full(256, 7, "u1")
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10] = 0, 1, 2, 3, 4
CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
CLASS[SYMBOL] = 6
CLASS[192:], CLASS[128:192] = 8, 9  # 9: bytes inside a character, not counted


@dataclass(frozen=True)
class Rules:
    common: int = 24  # common words of a language, besides all others as one
    class_limit: float = 0.09**0.5  # largest Jensen-Shannon distance (root of the divergence in bits) of character classes
    word_limit: float = 0.20**0.5  # and of common words
    class_chars: int = 200  # texts with fewer characters are not judged by classes
    word_words: int = 60  # nor those with fewer words by words
    reference_words: int = 2000  # words a language needs to have references of its own; others have those of all documents
    flush: int = 400_000  # words a task holds before it passes their counts on


def _shapes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters by class of every document."""
    n = len(at) - 1
    kind = CLASS[data]
    docs = np.repeat(np.arange(n, dtype="i8"), np.diff(at))
    counted = kind < CLASSES
    return np.bincount(docs[counted] * CLASSES + kind[counted], minlength=n * CLASSES).reshape(n, CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, the root of the divergence in bits, of each row of counts p from the counts q (or rows q); 0 for empty rows."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1)
    q = np.broadcast_to(q / np.maximum(q.sum(axis=-1, keepdims=True), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.where(p.sum(axis=-1) > 0, np.sqrt(np.maximum(d, 0) / 2), 0.0)


def reference_table(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, classes, keys, counts): class counts, hashes of common words, counts of these and of all other words.

    One row for every language of rules.reference_words words or more, and one with a null lang for all documents together.
    All words of all texts are counted, A-Z in lower case. Ties between common words are
    settled by their hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: dict = {}
        for b in slices(batches, "text"):
            data, at = text_bytes(b.column(0))
            langs = b.column(1).to_pylist()
            words = find_words(data, at)
            hashes, shapes, doc = hash_words(LOWER[data], words.starts, words.ends), _shapes(data, at), words.doc
            codes = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            code = np.array([codes[x] for x in langs])
            for x, i in codes.items():
                keys, n = np.unique(hashes[code[doc] == i], return_counts=True)
                c, k, m = held.get(x, (np.zeros(CLASSES, "i8"), keys[:0], n[:0]))
                keys, inverse = np.unique(np.concatenate([k, keys]), return_inverse=True)
                held[x] = (c + shapes[code == i].sum(axis=0), keys, np.bincount(inverse, np.concatenate([m, n])).astype("i8"))
            if sum(len(k) for _, k, _ in held.values()) > rules.flush:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    kind = "lang string, kind int, key long, n long"
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, kind)
    summed = materialise(rows.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "word-counts")  # texts go to Python once for this
    pooled = summed.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "key", "n")
    most = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    top = summed.filter("lang is not null").unionByName(pooled).withColumn("r", F.row_number().over(most)).filter(F.col("r") <= max(CLASSES, rules.common))
    entry = F.struct("key", "n")
    each = top.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == 0, entry))).alias("classes"),
        F.collect_list(F.when((F.col("kind") == 1) & (F.col("r") <= rules.common), entry)).alias("common"),
        F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("words"),
    )
    each = each.filter((F.col("words") >= rules.reference_words) | F.col("lang").isNull())

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                common = sorted((x["key"] % (1 << 64), x["key"], x["n"]) for x in r["common"])
                counts = [x[2] for x in common]
                out.append({"lang": r["lang"], "classes": [x["n"] for x in r["classes"]], "keys": [x[1] for x in common], "counts": [*counts, r["words"] - sum(counts)]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), *((c, pa.list_(pa.int64())) for c in ("classes", "keys", "counts"))]))

    found = materialise(each.mapInArrow(order, "lang string, classes array<long>, keys array<long>, counts array<long>"), "references")
    drop(summed)
    return found


def _arrays(classes: list, keys: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(classes, "i8"), np.array(keys, "i8").view("u8"), np.array(counts, "i8")


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> dict:
    """reference_table() as {lang: (classes, keys, counts)} on the driver, for tables with few languages."""
    return {r["lang"]: _arrays(*r[1:]) for r in reference_table(docs, rules, text, lang).collect()}


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    for x, (classes, keys, n) in held.items():
        kinds = np.concatenate([np.zeros(CLASSES, "i4"), np.ones(len(keys), "i4"), [2]]).astype("i4")
        cols = [pa.array([x] * len(kinds), pa.string()), pa.array(kinds), pa.array(np.concatenate([np.arange(CLASSES), keys.view("i8"), [0]])), pa.array(np.concatenate([classes, n, [n.sum()]]).astype("i8"))]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "kind", "key", "n"])


def repeated_words(hashes: np.ndarray, first: np.ndarray, n: int = 8) -> np.ndarray:
    """For each document the number of words inside windows of n words that the document holds twice or more."""
    found, at = windows(hashes, first, n)
    out = np.zeros(len(first) - 1, "i8")
    ends = np.searchsorted(at, first)
    for d in range(len(out)):
        own = found[ends[d] : ends[d + 1]]
        if len(own) < 2:
            continue
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if not same.any():
            continue
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cover = np.zeros(len(own) + n, "i8")
        np.add.at(cover, np.flatnonzero(twice), 1)
        np.add.at(cover, np.flatnonzero(twice) + n, -1)
        out[d] = np.count_nonzero(np.cumsum(cover))
    return out


LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ", ".join(f"{c}: long" for c in LONGS) + ", base_failed: boolean, class_js: double, word_js: double, kept: boolean"


def _judged(column: pa.Array, langs: list, held: list, found: dict, rules: Rules) -> pa.StructArray:
    """VERDICT of each text. held: (classes, keys, counts) of a text's own language, or null ones; found: references by language."""
    data, at = text_bytes(column)
    words = find_words(data, at)
    shapes, low = _shapes(data, at), hash_words(LOWER[data], words.starts, words.ends)
    n_words = np.diff(words.first)
    lines = [[x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")] for t in column.to_pylist()]
    repeats = repeated_words(hash_words(data, words.starts, words.ends), words.first)
    values = [
        n_words,
        per_doc(((data & 0xC0) != 0x80) & ~words.space, at),
        per_doc(SYMBOL[data], at),
        np.array([len(x) - len(set(x)) for x in lines], "i8"),
        repeats,
    ]
    failed = (n_words < 20) | (100 * repeats > 30 * n_words)
    js = np.full((2, len(langs)), np.nan)
    at_first = {x: i for i, x in reversed(list(enumerate(langs)))}
    for x, i in at_first.items():
        own = [h[i].as_py() for h in held]
        refs = _arrays(*own) if own and own[0] is not None else found.get(x, found.get(None))
        if refs is None:
            continue
        classes, keys, counts = refs
        own = np.flatnonzero([y == x for y in langs])
        js[0, own] = distance(shapes[own], classes)
        bins = np.searchsorted(keys, low)
        bins = np.where(np.append(keys, _U(0))[bins] == low, np.where(bins < len(keys), bins, len(keys)), len(keys))
        hist = np.bincount(words.doc * len(counts) + bins, minlength=len(langs) * len(counts)).reshape(len(langs), -1)
        js[1, own] = distance(hist[own], counts)
    js[0, shapes.sum(axis=1) < rules.class_chars] = np.nan
    js[1, n_words < rules.word_words] = np.nan
    kept = ~failed & ~(js[0] > rules.class_limit) & ~(js[1] > rules.word_limit)
    cols = [pa.array(v.astype("i8")) for v in values] + [pa.array(failed), *(pa.array(j, mask=np.isnan(j)) for j in js), pa.array(kept)]
    return pa.StructArray.from_arrays(cols, [*LONGS, "base_failed", "class_js", "word_js", "kept"])


def judge(docs: DataFrame, found: dict | None = None, rules: Rules = Rules(), text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The figures and verdict of every document, beside the columns named in keep (default: doc_id).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed: under 20 words, or over 30 % of the words
    in repeated 8-word windows; class_js, word_js: Jensen-Shannon distances from the language's references
    (those of all documents if it is null or has none of its own), null where the text is too short for them; kept: neither base_failed nor a distance over its limit.
    A null or empty text has no words and fails. References come from docs itself if not given.
    """
    table = reference_table(docs, rules, text, lang) if found is None else None
    found = {r["lang"]: _arrays(*r[1:]) for r in table.filter("lang is null").collect()} if found is None else found
    keep = ["doc_id"] if keep is None else keep
    own_columns = [] if table is None else ["__classes", "__keys", "__counts"]

    def look(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        lean()
        for column, langs, *held in batches:
            parts, at = [], 0
            for part in text_slices(column):
                end = at + len(part)
                parts.append(_judged(part, langs.slice(at, len(part)).to_pylist(), [h.slice(at, len(part)) for h in held], found, rules))
                at = end
            yield pa.concat_arrays(parts) if parts else _judged(column, [], [], found, rules)

    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))
    if table is not None:
        own = table.filter("lang is not null").select(F.col("lang").alias("__own"), *[F.col(c).alias("__" + c) for c in ("classes", "keys", "counts")])
        rows = rows.join(if_small(own, 100_000), F.col("__lang") == F.col("__own"), "left")
    judged = F.arrow_udf(look, f"struct<{VERDICT}>").asNondeterministic()  # so that no filter runs it again
    out = rows.select(*[f"__k{i}" for i in range(len(keep))], judged("__text", "__lang", *own_columns).alias("__v"))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "__v.*")
