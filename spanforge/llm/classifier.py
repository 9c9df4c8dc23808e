"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.batches import lean, slices, text_slices
from spanforge.llm.words import _BASE, _U, LOWER, SPACE, hash_words, mix, text_bytes

#: Bytes by kind: 0 white space, 1 letter or digit (all longer characters too), 2 other signs.
KIND = np.full(256, 2, "u1")
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[SPACE] = 0


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # of a feature's number
    rows: int = 8_000  # labelled rows to learn from at most: those with the smallest hash of doc_id
    epochs: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.5
    scale: float = 8.0  # length of a document's vector


def features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams of all documents, one after the other, and where each document's begin and end.

    Words here are runs of letters and digits or runs of other signs, A-Z in lower
    case. n-grams are single words, pairs of neighbours, and for a word equal
    to the one before it the pair "(any word), the same again".
    """
    kind = KIND[data]
    if not len(data):
        return np.zeros(0, "i8"), np.zeros(len(at), "i8")
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[at[at < len(data)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    h = hash_words(LOWER[data], starts, ends)
    first = np.searchsorted(starts, at)
    inner = np.ones(max(0, len(h) - 1), bool)
    cut = first[1:-1]
    inner[cut[(cut > 0) & (cut < len(h))] - 1] = False
    pairs = mix(h[:-1] * _BASE + h[1:] + _U(2))
    again = inner & (h[:-1] == h[1:])
    shift = _U(64 - bits)
    same = int(mix(np.array([3], "u8"))[0] >> shift)
    place = np.concatenate([np.arange(len(h)) * 3, np.flatnonzero(inner) * 3 + 1, np.flatnonzero(again) * 3 + 2])
    number = np.concatenate([mix(h + _U(1)) >> shift, pairs[inner] >> shift, np.full(np.count_nonzero(again), same, "u8")]).astype("i8")
    order = np.argsort(place, kind="stable")
    return number[order], np.searchsorted(place[order], first * 3)


def vector(numbers: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """A document's features and values: logarithmic counts, scaled to one length."""
    found, n = np.unique(numbers, return_counts=True)
    v = 1 + np.log(n)
    return found, v * (scale / np.sqrt((v * v).sum())) if len(v) else v


def train(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights, the intercept last. rows: (features, values, label), in the order to learn them in."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    held = list(rows)
    for _ in range(s.epochs):
        for i, x, y in held:
            i, x = np.append(i, size - 1), np.append(x, 1.0)
            w = _weights(z[i], n[i], s)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
            n[i] += g * g
    return _weights(z, n, s).astype("f4")


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    return np.where(np.abs(z) > s.l1, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2), 0.0)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights learnt from documents with a label, but none whose crc32(doc_id) mod 3 is 1.

    Of the labelled rows, those s.rows with the smallest hashes of doc_id are used, so a
    single task learns from a bounded sample, in the order of hash and doc_id. Rows without
    doc_id or label don't count; of several labels of a document the smallest does, of several rows with one doc_id that whose text has the
    smallest hash. Without any row the weights are 0.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y")).dropna()
    known = known.filter(F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(3)) != 1)
    known = known.groupBy("__id").agg(F.min("__y").alias("__y")).withColumn("__h", F.xxhash64("__id"))
    known = known.orderBy("__h", "__id").limit(s.rows)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(known), "__id")
    rows = rows.groupBy("__id", "__h", "__y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in slices(batches):
            numbers, at = features(*text_bytes(b.column(b.schema.get_field_index("text"))), s.bits)
            found = [vector(numbers[at[i] : at[i + 1]], s.scale) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("__h"), b.column("__id").cast(pa.string()), b.column("__y"), pa.array([f.astype("i4") for f, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))],
                ["h", "id", "y", "i", "x"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for y, i, x in zip(b.column("y").to_pylist(), b.column("i"), b.column("x"), strict=True):
                    yield i.values.to_numpy(), x.values.to_numpy(), y

        yield pa.RecordBatch.from_arrays([pa.array([train(each(), s).tobytes()], pa.binary())], ["w"])

    found = rows.select("text", "__h", "__id", "__y").mapInArrow(extract, "h long, id string, y int, i array<int>, x array<double>")
    one = found.repartition(1).sortWithinPartitions("h", "id")
    got = one.select("y", "i", "x").mapInArrow(learn, "w binary").collect()
    return np.frombuffer(got[0]["w"], "f4") if got else np.zeros((1 << s.bits) + 1, "f4")


def score(docs: DataFrame, weights: np.ndarray, s: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (default: doc_id) with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Sparse dot products of each whole text with the weights, which take 4 * (2 ** bits + 1)
    bytes whatever the data. A null or empty text gets the intercept's score. Texts alone go to Python, and only scores come back.
    """
    keep = ["doc_id"] if keep is None else keep

    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        w, bias = weights[:-1].astype("f8"), float(weights[-1])
        for column in texts:
            out = []
            for part in text_slices(column):
                numbers, at = features(*text_bytes(part), s.bits)
                for i in range(len(part)):
                    f, v = vector(numbers[at[i] : at[i + 1]], s.scale)
                    out.append(bias + w[f] @ v)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, "f8"), -35, 35))))

    rated = F.arrow_udf(rate, "double").asNondeterministic()  # so that no filter runs it again
    found = docs.select(*[F.col(c) for c in keep], rated(F.col(text)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
