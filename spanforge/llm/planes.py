"""Token-id files of compressed bit or byte planes, as a Python data source named `token_planes`.

A file holds blocks of BLOCK ids (the last may be shorter). A block is transposed
into 32 bit planes (or 4 byte planes), each plane compressed with zstandard; planes
of zeros alone take no room. The footer holds a chunk index (place, ids and plane
sizes of each block) and the documents in order (id and number of ids), so that any
range of ids is read by decoding only the blocks it touches.

Layout: MAGIC, blocks, index (Arrow stream), documents (Arrow stream), then the
two streams' sizes as little-endian unsigned 64-bit integers and MAGIC again.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spanforge.llm.batches import slices
from spanforge.llm.encode import byte_encoder, tokenizer_path
from spanforge.llm.files import filesystem, read_manifest, write_manifest
from spanforge.llm.storage import fresh_path, partitions

MAGIC, BLOCK, LEVEL = b"SFPLANE1", 1 << 16, 3
TOKENIZER = "byte_bpe_50k.json"


def to_planes(ids, planes: str) -> list[bytes]:
    """The planes of one block of little-endian unsigned 32-bit ids, lowest first; a plane of zeros is empty."""
    import numpy as np

    raw = np.ascontiguousarray(ids, dtype="<u4").view("u1").reshape(-1, 4)
    if planes == "byte":
        return [p.tobytes() if p.any() else b"" for p in raw.T]
    out = []
    for column in raw.T:
        if not column.any():
            out += [b""] * 8
            continue
        bits = np.unpackbits(np.ascontiguousarray(column)[:, None], axis=1, bitorder="little")
        out += [p.tobytes() if p.any() else b"" for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]
    return out


def from_planes(found: list[bytes], n: int):
    import numpy as np

    if len(found) == 4:
        raw = np.zeros((n, 4), "u1")
        for k, p in enumerate(found):
            if p:
                raw[:, k] = np.frombuffer(p, "u1")
        return raw.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for k, p in enumerate(found):
        if p:
            ids |= np.unpackbits(np.frombuffer(p, "u1"), count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return ids


class PlaneFile:
    """Writes one file; documents come in order, ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, out, planes: str = "bit", block: int = BLOCK) -> None:
        import zstandard

        self.out, self.planes, self.block = out, planes, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.index, self.docs, self.total, self.at = bytearray(), [], [], 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.total += len(ids) // 4
        self.held += ids
        size, at = 4 * self.block, 0
        while len(self.held) - at >= size:
            self._flush(bytes(self.held[at : at + size]))
            at += size
        if at:
            del self.held[:at]

    def _flush(self, ids: bytes) -> None:
        import numpy as np

        parts = [self.zip.compress(p) if p else b"" for p in to_planes(np.frombuffer(ids, "<u4"), self.planes)]
        self.index.append((self.at, len(ids) // 4, [len(p) for p in parts]))
        for p in parts:
            self.out.write(p)
        self.at += sum(map(len, parts))

    def close(self, id_type: pa.DataType = pa.int64()) -> int:
        if self.held:
            self._flush(bytes(self.held))
            self.held = bytearray()
        places, counts, sizes = ([x[i] for x in self.index] for i in range(3))
        index = pa.table({"place": pa.array(places, pa.int64()), "ids": pa.array(counts, pa.int64()), "sizes": pa.array(sizes, pa.list_(pa.int32()))})
        docs = pa.table({"doc_id": pa.array([d for d, _ in self.docs], id_type), "ids": pa.array([n for _, n in self.docs], pa.int64())})
        ends = [self.zip.compress(_stream(t)) for t in (index, docs)]
        for e in ends:
            self.out.write(e)
        self.out.write(struct.pack("<QQ", *map(len, ends)) + MAGIC)
        return self.total


def _stream(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


class PlaneReader:
    """Random access to one file: `f` can seek."""

    def __init__(self, f) -> None:
        import zstandard

        self.f, self.unzip = f, zstandard.ZstdDecompressor()
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 24)
        tail = f.read(24)
        if tail[16:] != MAGIC:
            raise ValueError("not a token plane file, or cut short")
        a, b = struct.unpack("<QQ", tail[:16])
        f.seek(end - 24 - a - b)
        self.index, self.docs = (pa.ipc.open_stream(self.unzip.decompress(f.read(n))).read_all() for n in (a, b))
        self.starts = [0]
        for n in self.index["ids"].to_pylist():
            self.starts.append(self.starts[-1] + n)
        self.last = (-1, None)

    def chunk(self, k: int):
        if self.last[0] != k:
            sizes, n = self.index["sizes"][k].as_py(), self.index["ids"][k].as_py()
            self.f.seek(self.index["place"][k].as_py())
            self.last = (k, from_planes([self.unzip.decompress(self.f.read(s)) if s else b"" for s in sizes], n))
        return self.last[1]

    def ids(self, start: int, n: int) -> Iterator:
        """The ids from number `start` on, as arrays of one block at most."""
        import bisect

        k = max(0, bisect.bisect_right(self.starts, start) - 1)
        while n > 0:
            part = self.chunk(k)[start - self.starts[k] : start - self.starts[k] + n]
            yield part
            start, n, k = start + len(part), n - len(part), k + 1


class TokenPlanes(DataSource):
    """Options: path; on writing planes (bit or byte), tokenizer (a path) and end_id; on reading ids (true: return each document's ids too).

    Written columns: doc_id and ids (binary, little-endian unsigned 32-bit), or doc_id and text if a tokenizer is
    named, which then encodes in the writing task and adds end_id to each document. Read columns: doc_id, start
    (ids of all documents before it), n_tokens, ids_crc32[, ids].
    """

    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> str:
        kind = self.options.get("id_type", "long")
        return f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * (self.options.get("ids") == "true")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    part: int
    file: str
    ids: int
    docs: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.planes"
        store, path = filesystem(self.options["path"])
        store.create_dir(path, recursive=True)
        with store.open_output_stream(posixpath.join(path, name)) as out:
            file, id_type = PlaneFile(out, self.options.get("planes", "bit")), pa.int64()
            for doc_ids, found in self.encoded(iterator):
                id_type = doc_ids.type
                for d, ids in zip(doc_ids.to_pylist(), found, strict=True):
                    file.add(d, ids)
            total = file.close(id_type)
        return _Written(part, name, total, len(file.docs))

    def encoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Document ids and their token ids, encoded here where the rows hold texts."""
        path, end = self.options.get("tokenizer"), struct.pack("<I", int(self.options.get("end_id", 0)))
        if not path:
            for b in batches:
                yield b.column("doc_id"), [x or b"" for x in b.column("ids").to_pylist()]
            return
        encoder = byte_encoder(path)
        for b in slices(batches):
            yield b.column("doc_id"), [x + end for x in encoder.encode([t or "" for t in b.column("text").to_pylist()])]

    def commit(self, messages: list) -> None:
        rows = sorted((m.part, m.file, m.ids, m.docs) for m in messages if m and m.docs)
        write_manifest(self.options["path"], {"files": [{"file": f, "ids": n, "docs": d} for _, f, n, d in rows]})

    def abort(self, messages: list) -> None:
        store, path = filesystem(self.options["path"])
        for m in messages:
            if m:
                store.delete_file(posixpath.join(path, m.file))


class _Part(InputPartition):
    def __init__(self, file: str, start: int) -> None:
        super().__init__(file)
        self.file, self.start = file, start


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        out, start = [], 0
        for f in read_manifest(self.options["path"])["files"]:
            out.append(_Part(f["file"], start))
            start += f["ids"]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(self.options["path"])
        if partition is None or not getattr(partition, "file", None):
            return
        with_ids = self.options.get("ids") == "true"
        with store.open_input_file(posixpath.join(path, partition.file)) as f:
            file, at = PlaneReader(f), 0
            for b in file.docs.to_batches(max_chunksize=1000):
                rows = []
                for n in b.column("ids").to_pylist():
                    crc, held = 0, []
                    for part in file.ids(at, n):
                        crc = zlib.crc32(part.tobytes(), crc)
                        if with_ids:
                            held.append(part.tobytes())
                    rows.append((partition.start + at, n, crc, b"".join(held)))
                    at += n
                cols = [b.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([r[3] for r in rows], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 0, planes: str = "byte", doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every document, adds end_id and writes the ids in ascending order of doc_id.

    Null ids come first; equal ids are in the order of a hash of their texts. A null text is
    empty and gives end_id alone. Rows are dealt out by range before they are encoded,
    so texts are shuffled once and each task encodes and writes its own file.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenPlanes)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = ["doc_id", "__h"]  # many rows of one id are split by their texts
    dealt = rows.withColumn("__h", F.xxhash64("text")).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("__h")
    options = {"path": out, "planes": planes, "tokenizer": path or tokenizer_path(TOKENIZER), "end_id": str(end_id)}
    dealt.write.format("token_planes").mode("append").options(**options).save()


def read_tokens(spark: SparkSession, path: str, ids: bool = False, id_type: str = "bigint") -> DataFrame:
    spark.dataSource.register(TokenPlanes)
    return spark.read.format("token_planes").option("ids", str(ids).lower()).option("id_type", id_type).load(path)


def round_trip(docs: DataFrame, path: str | None = None, planes: str = "byte") -> DataFrame:
    """Writes docs' tokens to the shared folder and reads back (doc_id, start, n_tokens, ids_crc32)."""
    out = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, path, planes=planes)
    return read_tokens(docs.sparkSession, out, id_type=dict(docs.dtypes)["doc_id"])
