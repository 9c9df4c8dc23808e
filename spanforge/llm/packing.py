"""Packing of tokenised documents into sequences by bin completion."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.batches import lean, slices, trim
from spanforge.llm.binpack import pack
from spanforge.llm.encode import tokenizer_path, word_encoder
from spanforge.llm.rownum import number_rows
from spanforge.llm.storage import materialise

TOKENIZER, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids with end_id after them, cut where a sequence is full.

    Only documents of more than `capacity` ids give more than one piece. A null or
    empty text gives one piece, end_id alone. Other columns are ignored.
    """
    path, end = path or tokenizer_path(TOKENIZER), struct.pack("<I", end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(word_encoder)
        encoder = word_encoder(path)
        for b in slices(batches):
            rows = []
            for d, found in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                found += end
                for k, at in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[at : at + 4 * capacity]
                    rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: len(names)])], names)
        encoder.forget()  # the worker may do other work next

    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def slots(patterns: Counter) -> dict[str, list[int]]:
    """The packing as ranges of pieces: pieces number rank .. rank + times * copies - 1 of a length belong to one pattern.

    The piece at place t of such a range is in sequence base + t mod times, at offset
    + (t div times) * length there.
    """
    out: dict[str, list[int]] = {k: [] for k in ("length", "rank", "base", "times", "offset")}
    used: Counter = Counter()
    base = 0
    for pattern, times in sorted(patterns.items()):
        offset = 0
        for length, copies in pattern:
            for k, v in zip(out, (length, used[length], base, times, offset), strict=True):
                out[k].append(v)
            used[length] += copies * times
            offset += copies * length
        base += times
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; pieces has a column `length` from 1 to the capacity and columns to order by.

    Only the number of pieces of each length comes to the driver: at most `capacity`
    rows, however many documents there are. `binpack.pack` decides on patterns there; a
    piece finds its place from its rank among the pieces of its length, by a
    search in the table of ranges that all tasks get (at most about 90 ranges a pattern, as
    no more lengths differ within one sequence, and one pattern ends with each length used up).
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = slots(pack(counts, capacity))
    trim()  # what the search held on the driver
    first, before = {}, 0
    for length in sorted(counts):
        first[length] = before
        before += counts[length]
    order = sorted(range(len(plan["length"])), key=lambda i: (plan["length"][i], plan["rank"][i]))
    starts = [first[plan["length"][i]] + plan["rank"][i] for i in order]  # in global row numbers
    held = [[plan[k][i] for i in order] for k in ("base", "times", "offset", "length")]
    numbered, _ = number_rows(pieces, [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")])
    names = [c for c in numbered.columns if c != "row_no"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lean()
        at = np.array(starts, "i8")
        base, times, offset, length = (np.array(x, "i8") for x in held)
        for b in batches:
            row = b.column("row_no").to_numpy()
            k = np.searchsorted(at, row, side="right") - 1
            t = row - at[k]
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(base[k] + t % times[k]), pa.array(offset[k] + t // times[k] * length[k])], [*names, "sequence_id", "offset"]
            )

    kinds = dict(numbered.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every piece's place: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Ties between pieces of one length are settled by doc_id, piece and contents; null
    ids come first. An empty table gives no rows.
    """
    return pack_pieces(materialise(cut_pieces(docs, path, capacity, ids=ids), "pieces"), capacity)
