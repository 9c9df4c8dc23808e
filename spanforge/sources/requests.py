"""Recorded requests as a Python data source named `recorded_requests`, read as a table or replayed as a stream."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from spanforge.sources.episodes import CHUNK, _lines, _open


class RecordedRequests(DataSource):
    """Option: path, a folder of text files with a request a line, as JSON.

    Rows: (file, place, message): the file's name, where in it the line begins, and the line. Blank lines are left out, as are hidden files. A stream's offset is the
    last file taken, in order of time of change and name; so it goes on behind that one after a restart, and files that come later are taken later.
    Files are read in ranges of CHUNK bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_requests"

    def schema(self) -> str:
        return "file string, place long, message string"

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"])


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


def _files(uri: str) -> list[tuple[int, str, int]]:
    """(time of change, name, size) of the folder's files, in that order."""
    from pyarrow import fs

    store, path = _open(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _ranges(files: list[tuple[int, str, int]]) -> list[InputPartition]:
    return [_Range(name, a, min(size, a + CHUNK)) for _, name, size in files for a in range(0, size, CHUNK)]


def _rows(uri: str, part: _Range) -> Iterator[tuple]:
    store, path = _open(posixpath.join(uri, part.file))
    with store.open_input_file(path) as f:
        for place, line in _lines(f, part.start, part.end):
            yield part.file, place, line.decode("utf-8", "replace").rstrip("\r")


class _Table(DataSourceReader):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        return _ranges(_files(self.uri)) or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        return _rows(self.uri, part) if part.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.uri)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges([f for f in _files(self.uri) if (start["time"], start["name"]) < f[:2] <= (end["time"], end["name"])])

    def read(self, part: _Range) -> Iterator[tuple]:
        return _rows(self.uri, part)

    def commit(self, end: dict) -> None:
        """Nothing goes: the recording may be replayed by others."""


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RecordedRequests)
    return spark.read.format("recorded_requests").load(path)


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RecordedRequests)
    return spark.readStream.format("recorded_requests").load(path)
