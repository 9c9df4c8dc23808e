"""WARC archives as a Python data source named `warc`.

Each record is one gzip member whose extra field `sl` holds the member's
compressed size, so a reader inflates a record's header block first, tests the
pushed-down predicates on it and skips the rest of an unwanted record without
inflating it. Members without that field are read to their end.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from spanforge.llm.files import filesystem, read_manifest, write_manifest
from spanforge.llm.storage import fresh_path

FILE_BYTES = 64 << 20
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Where records carry what the columns hold; payload and payload_bytes come from the block.
HEADERS = {"record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_id": "WARC-Record-ID", "payload_digest": "WARC-Payload-Digest", "refers_to": "X-Refers-To-Page", "page_id": "X-Page-Id"}
SCHEMA = "page_id long, record_id string, record_type string, target_uri string, payload_digest string, refers_to long, payload_bytes long, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: str) -> bytes:
    return f"{name}: {value}".replace("\r", " ").replace("\n", " ").encode() + CRLF


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same for the same page and payload, whoever writes it and how often; that of a page without id depends on its address."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{digest}' if page_id is None else f'page:{page_id}|{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record of an HTTP response, or of a revisit without the payload, which names the record that it repeats."""
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK" + CRLF + _line("Content-Type", "text/html; charset=utf-8") + _line("Content-Length", str(len(payload))) + CRLF
    block = http if revisit else http + payload
    lines = [
        _line("WARC-Type", "revisit" if revisit else "response"),
        _line("WARC-Record-ID", record_id(page_id, url, digest)),
        _line("WARC-Date", "2024-01-01T00:00:00Z"),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("WARC-Payload-Digest", "sha1:" + digest),
        _line("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        lines.append(_line("X-Page-Id", str(page_id)))
    if url is not None:
        lines.append(_line("WARC-Target-URI", url))
    if revisit:
        lines += [_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", record_id(refers_to, None, digest)), _line("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1" + CRLF + b"".join(lines) + _line("Content-Length", str(len(block))) + CRLF + block + CRLF + CRLF


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with the extra field sl: compressed and uncompressed size, 0 where it takes over 32 bits."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    sizes = struct.pack("<II", *(x if x < 1 << 32 else 0 for x in (size, len(data))))
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + sizes
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_size(head: bytes) -> int:
    """The compressed size in the extra field sl, or 0."""
    if len(head) < 12 or not head[3] & 4:
        return 0
    extra, at = head[12 : 12 + struct.unpack("<H", head[10:12])[0]], 0
    while at + 4 <= len(extra):
        n = struct.unpack("<H", extra[at + 2 : at + 4])[0]
        if extra[at : at + 2] == b"sl" and n >= 4:
            return struct.unpack("<I", extra[at + 4 : at + 8])[0]
        at += 4 + n
    return 0


class Seen:
    """A record: its headers, and its block, which is read and inflated when block() is called, before the next record is asked for."""

    def __init__(self, headers: dict[str, str], load: Callable[[], bytes]) -> None:
        self.headers, self._load, self.inflated = headers, load, 0

    def block(self) -> bytes:
        body = self._load()
        self.inflated = len(body)
        return body


class _Member:
    """One gzip member of an open file, inflated as far as is asked for."""

    def __init__(self, f, at: int) -> None:
        self.f, self.z = f, zlib.decompressobj(31)
        f.seek(at)
        head = f.read(1 << 12)
        self.empty, self.size, self.place = not head, _member_size(head), at + len(head)
        self.text = self.z.decompress(head, 1 << 12) if head else b""

    def more(self, most: int) -> bytes:
        data = self.z.unconsumed_tail
        if not data:
            self.f.seek(self.place)
            data = self.f.read(1 << 16)
            self.place += len(data)
        if not data:
            raise EOFError("a WARC record is cut short")
        return self.z.decompress(data, most)

    def end(self) -> int:
        """Where the next member begins."""
        while not self.z.eof:
            self.more(1 << 20)
        return self.place - len(self.z.unused_data)


def read_records(f, wanted=lambda headers: True) -> Iterator[Seen]:
    """Records of an open .warc.gz or .warc file whose headers are wanted."""
    magic = f.read(2)
    f.seek(0)
    if magic != b"\x1f\x8b":
        yield from _plain(f, wanted)
        return
    at = 0
    while True:
        m = _Member(f, at)
        if m.empty:
            return
        while CRLF * 2 not in m.text and not m.z.eof:
            m.text += m.more(1 << 14)
        headers, _, rest = m.text.partition(CRLF * 2)
        parsed = _headers(headers)
        if wanted(parsed):
            yield Seen(parsed, lambda m=m, rest=rest, n=int(parsed.get("content-length", 0)): _inflated(m, rest, n))
        at = at + m.size if m.size else m.end()


def _inflated(m: _Member, rest: bytes, n: int) -> bytes:
    parts, held = [rest], len(rest)
    while held < n and not m.z.eof:
        parts.append(m.more(1 << 20))
        held += len(parts[-1])
    return b"".join(parts)[:n]


def _plain(f, wanted) -> Iterator[Seen]:
    at = 0
    while True:
        f.seek(at)
        text = f.read(1 << 12)
        if not text:
            return
        while CRLF * 2 not in text:
            more = f.read(1 << 12)
            if not more:
                raise EOFError("a WARC header is cut short")
            text += more
        headers = text.partition(CRLF * 2)[0]
        parsed, start = _headers(headers), at + len(headers) + 4
        n = int(parsed.get("content-length", 0))
        if wanted(parsed):
            yield Seen(parsed, lambda start=start, n=n: (f.seek(start), f.read(n))[1])
        at = start + n + 4


def _headers(text: bytes) -> dict[str, str]:
    lines = text.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}


def row(headers: dict[str, str], block: bytes | None, check: bool = False) -> dict:
    """The columns of one record; block None: the payload isn't wanted. check: compute size and digest from the payload."""
    kind = headers.get("warc-type")
    payload = block.partition(CRLF * 2)[2] if block is not None and kind == "response" else None
    size, digest = int(headers.get("x-payload-length", headers.get("content-length", 0))), headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if check and payload is not None:
        size, digest = len(payload), digest32(payload)
    refers = headers.get("x-refers-to-page", "")
    return {
        "page_id": int(headers["x-page-id"]) if "x-page-id" in headers else None,
        "record_id": headers.get("warc-record-id"),
        "record_type": kind,
        "target_uri": headers.get("warc-target-uri"),
        "payload_digest": digest or None,
        "refers_to": int(refers) if refers.lstrip("-").isdigit() else None,
        "payload_bytes": size,
        "payload": payload,
    }


class Warc(DataSource):
    """Options: path; payload (false: leave payloads undecoded and null); check (true: size and digest from the payload);
    max_file_bytes on writing. Written columns: page_id, url, html (binary), refers_to, revisit."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    part: int
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, path = filesystem(self.options["path"])
        store.create_dir(path, recursive=True)
        most, files, out = int(self.options.get("max_file_bytes", FILE_BYTES)), [], None
        for b in iterator:
            for page_id, url, html, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                if out is None or files[-1][1] >= most:
                    if out:
                        out.close()
                    files.append([f"part-{uuid.uuid4().hex}.warc.gz", 0])
                    out = store.open_output_stream(posixpath.join(path, files[-1][0]), compression=None)
                data = member(record(page_id, url, html or b"", refers_to, revisit))
                out.write(data)
                files[-1][1] += len(data)
        if out:
            out.close()
        return _Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list) -> None:
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        write_manifest(self.options["path"], {"files": files})

    def abort(self, messages: list) -> None:
        store, path = filesystem(self.options["path"])
        for m in messages:
            for f, _ in m.files if m else ():
                store.delete_file(posixpath.join(path, f))


class _File(InputPartition):
    def __init__(self, file: str) -> None:
        super().__init__(file)
        self.file = file


class WarcReader(DataSourceReader):
    """One partition a file. Predicates on columns that headers hold are tested before a record's payload is inflated."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(("in", column, (f.value,)))
            elif isinstance(f, In):
                self.tests.append(("in", column, tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("starts", column, (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append(("some", column, ()))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        if not self.tests:
            return True
        found = row(headers, None)
        for kind, column, values in self.tests:
            v = found[column]
            if v is None or (kind == "in" and v not in values) or (kind == "starts" and not v.startswith(values[0])):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = filesystem(self.options["path"])
        if store.get_file_info(posixpath.join(path, "_manifest.json")).type == fs.FileType.File:
            return [_File(posixpath.join(path, f)) for f, _ in read_manifest(self.options["path"])["files"]]
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(x.path) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "file", None):
            return
        store, _ = filesystem(self.options["path"])
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        check, body = self.options.get("check") == "true", self.options.get("payload", "true") == "true"
        with store.open_input_file(partition.file) as f:
            held, size = [], 0
            for r in read_records(f, self.wanted):
                needed = (body or check) and r.headers.get("warc-type") == "response"
                found = row(r.headers, r.block() if needed else None, check)
                if not body:
                    found["payload"] = None
                held.append(found)
                size += 500 + len(found["payload"] or b"")
                if size > 4 << 20:
                    yield _batch(held, kinds)
                    held, size = [], 0
            if held:
                yield _batch(held, kinds)


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in rows[0]})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def mark_revisits(pages: DataFrame, least: int = 0, salts: int = 64) -> DataFrame:
    """(page_id, url, html binary, refers_to, revisit): which records repeat the payload of one with a smaller page_id.

    A null html is an empty payload. Payloads under `least` bytes are never revisits.
    Of rows with equal payloads those with the smallest page_id are responses (all, if the row
    itself is repeated); a row without page_id revisits them, or is a response where none has one.
    Equal payloads are found by SHA-1 and size. The smallest id is taken per digest and salt
    first and joined back on both, so a payload that a third of all pages share is dealt out over `salts` tasks at least.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    ).select("*", F.unhex(F.sha1("html")).alias("__d"), F.octet_length("html").alias("__n"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).alias("__s"))
    parts = keyed.groupBy("__d", "__n", "__s").agg(F.min("page_id").alias("__m"))
    whole = parts.groupBy("__d", "__n").agg(F.min("__m").alias("__first"), F.collect_list("__s").alias("__salts"))
    firsts = whole.select("__d", "__n", "__first", F.explode("__salts").alias("__s"))
    joined = keyed.join(firsts, ["__d", "__n", "__s"])
    revisit = (F.col("__n") >= least) & F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("__first")).alias("refers_to"), revisit.alias("revisit"))


def write_archive(pages: DataFrame, out: str, least: int = 0) -> None:
    register(pages.sparkSession)
    mark_revisits(pages, least).write.format("warc").mode("append").option("path", out).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True, check: bool = False) -> DataFrame:
    """Rows of SCHEMA. `refers_to` is the page_id of the record that a revisit names."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("check", str(check).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives to the shared folder and reads them back, sizes and digests computed from the payloads read."""
    out = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, out, least)
    return read_archive(pages.sparkSession, out, payload=False, check=True)
