"""Language identification: script ranges narrow a word's candidates, and the cheapest path through the words, with a price for switching, labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.batches import lean, slices, text_slices
from spanforge.llm.storage import if_small, materialise
from spanforge.llm.words import _U, LOWER, hash_words, mix, text_bytes

#: Scripts by ranges of code points (fixed values); what lies in none is "other". Scripts marked * are written without spaces, so each of their characters is a word.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("arabic", 0x8A0, 0x8FF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFE),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai*", 0xE00, 0xE7F), ("lao*", 0xE80, 0xEFF),
    ("tibetan*", 0xF00, 0xFFF), ("myanmar*", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7AF),
    ("ethiopic", 0x1200, 0x137F), ("khmer*", 0x1780, 0x17FF), ("kana*", 0x3040, 0x30FF), ("han*", 0x3400, 0x9FFF), ("han*", 0xF900, 0xFAFF), ("han*", 0x20000, 0x3FFFF),
]
NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
LATIN = NAMES.index("latin")
UNSPACED = np.array([s.endswith("*") for s in NAMES])
_RANGES = sorted((a, b, NAMES.index(s)) for s, a, b in SCRIPTS)
_FROM, _TO, _SCRIPT = (np.array(x) for x in zip(*_RANGES, strict=True))
SIZE = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)  # of a character, by its first byte
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True  # first bytes
BARRED = np.float32(-1e4)


@dataclass(frozen=True)
class Settings:
    rows: int = 2000  # documents of a language to learn from at most: those with the smallest hashes of doc_id
    bits: int = 16  # of a feature's number, less where there are so many languages that the table would pass `cells`
    cells: int = 1 << 24
    smooth: float = 0.5
    share: float = 0.01  # of a language's letters that a script needs to be one of its own
    overlap: float = 0.5  # weight of a trigram, as neighbours share letters
    switch: float = 12.0  # price of a switch, in nats


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # feature x language
    barred: np.ndarray  # script x language: the script isn't the language's, but some language's
    bits: int


def letter_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, their scripts, and the words with which documents begin.

    A word is a run of letters of one script, or a character of a script without spaces. Letters are A-Z, a-z and all longer
    characters, but the signs of U+0080 to U+00BF, U+2000 to U+2BFF, U+3000 to U+303F and U+1F000 to U+1FFFF.
    """
    lead = np.flatnonzero(LETTER[data])
    b0 = data[lead]
    sign = b0 == 0xC2
    if (long := b0 >= 0xE0).any():
        b1 = np.where(long, data[np.minimum(lead + 1, len(data) - 1)], 0)
        sign |= ((b0 == 0xE2) & (b1 < 0xB0)) | ((b0 == 0xE3) & (b1 == 0x80)) | ((b0 == 0xF0) & (b1 == 0x9F))
    lead, b0 = lead[~sign], b0[~sign]
    size = SIZE[b0]
    script = np.full(len(lead), LATIN, "i1")
    more = np.flatnonzero(b0 >= 0xC4)  # C3: Latin
    if len(more):
        point, n = b0[more].astype("i4") & (0xFF >> (size[more] + 1)), size[more]
        for k in range(1, 4):
            on = n > k
            point[on] = (point[on] << 6) | (data[lead[more[on]] + k] & 0x3F)
        i = np.maximum(np.searchsorted(_FROM, point, side="right") - 1, 0)
        script[more] = np.where((point >= _FROM[i]) & (point <= _TO[i]), _SCRIPT[i], 0)
    new = np.ones(len(lead), bool)
    new[1:] = (lead[:-1] + size[:-1] != lead[1:]) | (script[1:] != script[:-1]) | UNSPACED[script[1:]]
    new[np.searchsorted(lead, at[:-1])[np.searchsorted(lead, at[:-1]) < len(lead)]] = True
    starts, last = lead[new], np.append(np.flatnonzero(new)[1:], len(lead)) - 1
    return starts, (lead + size)[last] if len(lead) else starts, script[new], np.searchsorted(starts, at)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 (U+00C0 to U+00DE) in lower case."""
    low = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] < 0x9F) & (data[second] != 0x97)]
    low[second] += 0x20
    return low


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the byte trigrams of all words, a blank beyond either end, where each word's begin, and numbers of whole words."""
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(starts - first[:-1], size)
    here = low[at].astype("u4")
    before, after = np.empty_like(here), np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[first[:-1]], after[first[1:] - 1] = 32, 32
    code = (before << 16 | here << 8 | after) * np.uint32(2654435761)
    return code >> np.uint32(32 - bits), first[:-1], (mix(hash_words(low, starts, ends) + _U(3)) >> _U(64 - bits)).astype("i8")


def fit(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """How often each language has each feature and script, from documents with a language and text, none whose crc32(doc_id) mod 4 is 2.

    Of each language, up to s.rows documents count, whole; of several rows with one doc_id and language that whose text has the smallest hash.
    Features are counted where the texts are and summed by language; a vector a language comes to the driver, s.cells numbers in all at most.
    Rows without doc_id aren't learned from. Without rows the model knows no language.
    """
    known = docs.select(F.col(doc_id).alias("__id"), F.col(lang).cast("string").alias("__lang"), F.col(text).alias("text")).dropna()
    known = known.filter(F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(4)) != 2)
    by_hash = Window.partitionBy("__lang").orderBy("__h", "__id")
    chosen = known.select("__id", "__lang").distinct().withColumn("__h", F.xxhash64("__id")).withColumn("__r", F.row_number().over(by_hash))
    chosen = materialise(chosen.filter(F.col("__r") <= s.rows).select("__id", "__lang"), "chosen")
    langs = sorted(r[0] for r in chosen.select("__lang").distinct().collect())
    bits = s.bits
    while len(langs) << bits > s.cells and bits > 8:
        bits -= 1
    rows = known.join(if_small(chosen), ["__id", "__lang"]).groupBy("__id", "__lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    size = (1 << bits) + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: dict[str, np.ndarray] = {}
        for b in slices(batches):
            data, at = text_bytes(b.column(0))
            low = lowered(data)
            starts, ends, script, first = letter_words(data, at)
            grams, gram_at, whole = features(low, starts, ends, bits)
            gram_at = np.append(gram_at, len(grams))
            for i, x in enumerate(b.column(1).to_pylist()):
                n = held.setdefault(x, np.zeros(size, "i8"))
                own = slice(first[i], first[i + 1])
                np.add.at(n, grams[gram_at[first[i]] : gram_at[first[i + 1]]], 1)
                np.add.at(n, whole[own], 1)
                np.add.at(n, script[own].astype("i8") + (1 << bits), ends[own] - starts[own])
        for x, n in held.items():
            keys = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array(keys.astype("i4")), pa.array(n[keys])], ["lang", "key", "n"])

    def vector(table: pa.Table) -> pa.Table:
        n = np.zeros(size, "i8")
        n[table.column("key").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": [table.column("lang")[0].as_py()], "n": pa.array([n.tobytes()], pa.binary())})

    summed = rows.select("text", "__lang").mapInArrow(count, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    found = {r["lang"]: np.frombuffer(r["n"], "i8") for r in summed.groupBy("lang").applyInArrow(vector, "lang string, n binary").collect()}
    langs = sorted(found)
    if not langs:
        return Model([], np.zeros((1 << bits, 0), "f4"), np.zeros((len(NAMES), 0), bool), bits)
    counts = np.array([found[x] for x in langs], "f8")
    grams, scripts = counts[:, : 1 << bits], counts[:, 1 << bits :]
    even = grams * (grams.sum() / len(langs) / np.maximum(grams.sum(axis=1, keepdims=True), 1))  # as if all languages had as much text
    weights = np.log(even + s.smooth)
    weights -= weights.mean(axis=0)
    own = scripts >= s.share * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.ascontiguousarray(weights.T, "f4"), (~own & own.any(axis=0)).T, bits)


def evidence(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, script: np.ndarray, model: Model, s: Settings) -> np.ndarray:
    """Score of each word for each language: sums of log-likelihoods less their mean over languages; far below for languages of other scripts."""
    if not len(starts):
        return np.zeros((0, len(model.langs)), "f4")
    grams, at, whole = features(lowered(data), starts, ends, model.bits)
    out = np.add.reduceat(model.weights[grams], at, axis=0) * np.float32(s.overlap) + model.weights[whole]
    return np.where(model.barred[script], BARRED, out)


def best_path(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Each word's language on its document's best path: the largest sum of scores less `switch` for every change. Equal paths: the first language.

    A document stays in the language with the largest sum if no other gains more than `switch` against it over any stretch of words, as then no
    detour pays. The others' paths are found step by step, for all of them at once, longest first.
    """
    n = np.diff(first)
    some = np.flatnonzero(n)
    out = np.zeros(len(scores), "i4")
    if not len(some):
        return out
    begins = first[:-1][some]
    scores = scores.astype("f8")
    doc = np.repeat(np.arange(len(some)), n[some])
    steady = np.add.reduceat(scores, begins, axis=0).argmax(axis=1)
    out[:] = steady[doc]
    gain = scores - scores[np.arange(len(scores)), out][:, None]
    total = np.cumsum(gain, axis=0)
    total -= (total[begins] - gain[begins])[doc]  # from the document's start on
    total -= (doc * (4 * np.abs(total).max() + 1))[:, None]  # so that the least sum so far starts anew with each document
    most = np.maximum.reduceat((total - np.minimum.accumulate(total - gain, axis=0)).max(axis=1), begins)
    hard = some[most > switch]
    if not len(hard):
        return out
    hard = hard[np.argsort(-n[hard], kind="stable")]
    at, size = first[:-1][hard], n[hard]
    lengths = np.arange(int(size[0]))
    active = np.searchsorted(-size, -lengths, side="left")  # documents longer than i words
    came = {}
    best = np.zeros((len(hard), scores.shape[1]))
    every = np.arange(scores.shape[1])
    for i in lengths:
        k = active[i]
        now = best[:k]
        if i:
            top = now.argmax(axis=1)
            other = now[np.arange(k), top][:, None] - switch
            stay = now >= other
            came[i] = np.where(stay, every, top[:, None]).astype("i2")
            now = np.where(stay, now, other)
        best[:k] = now + scores[at[:k] + i]
    state = best.argmax(axis=1)
    for i in lengths[::-1]:
        k = active[i]
        out[at[:k] + i] = state[:k]
        if i:
            state[:k] = came[i][np.arange(k), state[:k]]
    return out


def _labelled(column: pa.Array, model: Model, s: Settings) -> pa.StructArray:
    data, at = text_bytes(column)
    starts, ends, script, first = letter_words(data, at)
    n, k = len(column), len(model.langs)
    path = best_path(evidence(data, starts, ends, script, model, s), first, s.switch) if k else np.zeros(len(starts), "i4")
    doc = np.repeat(np.arange(n), np.diff(first))
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before a byte
    letters = np.zeros((n, max(k, 1)), "i8")
    np.add.at(letters, (doc, path), place[ends] - place[starts])
    ascii_letter = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
    has = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~has & (at[1:] > at[:-1])):
        has[i] = any(map(str.isalpha, column[i].as_py()))
    has &= k > 0
    total = letters.sum(axis=1)
    lang = letters.argmax(axis=1)
    score = np.where(has, np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 1 / max(k, 1)), 0.0)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
    opens = np.flatnonzero(new & has[doc]) if len(path) else np.zeros(0, "i8")
    closes = np.flatnonzero(np.append(new[1:], True) & has[doc]) if len(path) else opens
    names = pa.array([*model.langs, "und"], pa.string())
    base = place[at[:-1]][doc]
    spans = pa.StructArray.from_arrays(
        [names.take(pa.array(path[opens])), pa.array((place[starts[opens]] - base[opens]).astype("i8")), pa.array((place[ends[closes]] - base[closes]).astype("i8"))], ["lang", "start", "end"]
    )
    offsets = np.searchsorted(doc[opens], np.arange(n + 1)).astype("i4")
    return pa.StructArray.from_arrays([names.take(pa.array(np.where(has, lang, k))), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)], ["lang_pred", "score", "spans"])


def languages(texts: Column, model: Model, s: Settings = Settings()) -> Column:
    """lang_pred: the language of most letters; score: its share of them; spans: (lang, start, end) in characters, from a word's start to a word's end.

    Whole texts are labelled. Texts that are null or have no letter, and all texts where the model knows no language, are `und` with
    score 0 and no spans; texts whose only letters stand among signs (see letter_words) get the first language and 1 / number of languages.
    """
    schema = "struct<lang_pred: string, score: double, spans: array<struct<lang: string, start: long, end: long>>>"
    most = (2 << 20) * 8 // max(8, len(model.langs))

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        for column in batches:
            parts = [_labelled(part, model, s) for part in text_slices(column, most)]
            yield pa.concat_arrays(parts) if parts else _labelled(column, model, s)

    return F.arrow_udf(label, schema).asNondeterministic()(texts)  # so that no filter runs it again


def identify(docs: DataFrame, model: Model, s: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (default: doc_id) with lang_pred, score and spans, see languages(). Each row is judged by its own text alone."""
    keep = ["doc_id"] if keep is None else keep
    found = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], languages(F.col(text), model, s).alias("__v"))
    return found.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "__v.*")
