"""A dataset of episodes as a Python data source named `episodes`."""

from __future__ import annotations

import json
import operator
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# Files of a dataset, and the folder whose datasets keep their annotations a task each.
EPISODES, TASKS, INFO = "meta/episodes.jsonl", "meta/tasks.jsonl", "meta/info.json"
BY_TASK, BY_TASK_FILE = "2025-challenge-demos", "annotations/{}/episodes_lang_mem.jsonl"
CHUNK = 4 << 20
PLACES = ".places"  # what stands after the name of a file whose places are noted


def _open(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class Episodes(DataSource):
    """Options: path, the dataset's folder; file, the episodes' file (default: meta/episodes.jsonl, or the task's own annotations).

    Rows: (episode_index, length, tasks, fps, action_config, chunk, data_path): fps is the episode's own, else the dataset's, else 30; data_path is
    where the dataset's info.json puts the episode's frames, null without one. With a schema of fewer columns only these are made; it may also
    ask for `place`, where in the file the episode's line begins. The file is read in ranges of CHUNK bytes. With the option pushdown predicates on
    episode_index are applied here, and where `write_places` has noted the places of this file, only the wanted episodes' lines are read.
    """

    @classmethod
    def name(cls) -> str:
        return "episodes"

    def schema(self) -> str:
        segment = "struct<seg_id:long,start_frame:long,end_frame:long,action_text:string,skill:string,language_memory:string>"
        return f"episode_index long, length long, tasks array<string>, fps double, action_config array<{segment}>, chunk long, data_path string"

    def reader(self, schema) -> DataSourceReader:
        kind = _Choosy if self.options.get("pushdown") == "true" else _Reader
        return kind(dict(self.options), schema.names)


class _Part(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


def locate(path: str, file: str | None = None) -> tuple[str, str]:
    """(folder, episodes' file) of a dataset."""
    root = path.rstrip("/")
    if BY_TASK in root:
        return posixpath.dirname(root), file or BY_TASK_FILE.format(posixpath.basename(root))
    return root, file or EPISODES


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.root, self.file = locate(options["path"], options.get("file"))
        self.names, self.tests = names, []

    def _wanted(self, index: int) -> bool:
        return all(TESTS[kind](index, value) for _, kind, value in self.tests)

    def _json(self, name: str) -> dict:
        store, path = _open(posixpath.join(self.root, name))
        try:
            with store.open_input_stream(path) as f:
                return json.loads(f.readall())
        except FileNotFoundError:
            return {}

    def _places(self, size: int) -> list[int] | None:
        """Where the wanted episodes' lines begin; None where that isn't known of a file of this size."""
        from pyarrow import parquet

        store, path = _open(posixpath.join(self.root, self.file + PLACES))
        if store.get_file_info([path])[0].type.name == "NotFound":
            return None
        if parquet.read_table(path, filesystem=store, columns=["size"], filters=[("size", "!=", size)]).num_rows:
            return None
        return sorted(parquet.read_table(path, filesystem=store, filters=self.tests).column("place").to_pylist())

    def partitions(self) -> list[InputPartition]:
        store, path = _open(posixpath.join(self.root, self.file))
        size = store.get_file_info([path])[0].size
        if size is None:
            raise FileNotFoundError(path)
        places = self._places(size) if self.tests else None
        if places is not None:
            return [_Part(p, p + 1) for p in places] or [_Part(0, 0)]  # the lines that begin there, and nothing between them
        return [_Part(a, min(size, a + CHUNK)) for a in range(0, size, CHUNK)] or [_Part(0, 0)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        info = self._json(INFO) if {"fps", "chunk", "data_path"} & set(self.names) else {}
        store, path = _open(posixpath.join(self.root, self.file))
        with store.open_input_file(path) as f:
            for place, line in _lines(f, part.start, part.end):
                episode = json.loads(line)
                if self._wanted(int(episode["episode_index"])):
                    yield _row(episode, info, self.names, place)


class _Choosy(_Reader):
    """A reader that takes predicates; Spark allows one only where the session's setting does."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute == ("episode_index",):
                self.tests.append(("episode_index", kinds[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f


def _lines(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Where the lines that begin in [start, end) begin, and the lines, blank ones left out."""
    at = max(0, start - 1)
    f.seek(at)
    held = b""
    if start:  # up to the end of the line that began before
        while True:
            block = f.read(1 << 16)
            if not block:
                return
            at += len(block)
            if (k := block.find(b"\n")) >= 0:
                held = block[k + 1 :]
                break
    begin = at - len(held)
    while begin < end:
        k = held.find(b"\n")
        if k < 0:
            block = f.read(1 << 16)
            if block:
                held += block
                continue
            if held.strip():
                yield begin, held
            return
        if held[:k].strip():
            yield begin, held[:k]
        begin += k + 1
        held = held[k + 1 :]


def _row(episode: dict, info: dict, names: list[str], place: int) -> tuple:
    """The columns that are asked for; no other is made."""
    return tuple(MADE[n](episode, info, place) for n in names)


def _tasks(episode: dict) -> list[str]:
    tasks = episode.get("tasks", [])
    return [str(t) for t in (tasks if isinstance(tasks, list) else [tasks])]


def _segments(episode: dict) -> list[tuple]:
    return [
        (_int(s.get("seg_id", i)), _int(s.get("start_frame")), _int(s.get("end_frame")), _text(s.get("action_text")), _text(s.get("skill")), _text(s.get("language_memory")))
        for i, s in enumerate(episode.get("action_config") or [])
    ]


def _chunk(episode: dict, info: dict) -> int:
    return int(episode["episode_index"]) // int(info["chunks_size"]) if info.get("chunks_size") else 0


def _where(episode: dict, info: dict) -> str | None:
    return info["data_path"].format(episode_chunk=_chunk(episode, info), episode_index=int(episode["episode_index"])) if "data_path" in info else None


def _int(x) -> int | None:
    return None if x is None else int(x)


def _text(x) -> str | None:
    return None if x is None else str(x)


def _fps(episode: dict, info: dict) -> float:
    for held in (episode, info):
        if "fps" in held:
            return float(held["fps"])
    rates = (meta[k]["video.fps"] for meta in (info.get("features") or {}).values() for k in ("video_info", "info") if isinstance(meta, dict) and "video.fps" in (meta.get(k) or {}))
    return float(next(rates, 30.0))


MADE = {
    "episode_index": lambda e, info, place: int(e["episode_index"]), "length": lambda e, info, place: _int(e.get("length")), "tasks": lambda e, info, place: _tasks(e), "fps": lambda e, info, place: _fps(e, info),
    "action_config": lambda e, info, place: _segments(e), "chunk": lambda e, info, place: _chunk(e, info), "data_path": lambda e, info, place: _where(e, info), "place": lambda e, info, place: place,
}
TESTS = {"==": operator.eq, "in": lambda x, xs: x in xs, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def read_dataset(spark: SparkSession, path: str, file: str | None = None, columns: str | None = None) -> DataFrame:
    """A dataset's episodes. columns: the schema of those that are wanted, if not all.

    Predicates reach the source where the session has `spark.sql.python.filterPushdown.enabled`.
    """
    spark.dataSource.register(Episodes)
    reader = spark.read.format("episodes")
    reader = reader.schema(columns) if columns else reader
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("file", file) if file else reader).load(path)


def write_places(spark: SparkSession, path: str, file: str | None = None) -> None:
    """Notes beside the episodes' file where each episode's line begins, in order of episode_index. What is noted counts as long as the file has the size it had."""
    root, name = locate(path, file)
    store, at = _open(posixpath.join(root, name))
    size = store.get_file_info([at])[0].size
    rows = read_dataset(spark, path, file, "episode_index long, place long")
    rows.withColumn("size", F.lit(size).cast("long")).orderBy("episode_index", "place").write.mode("overwrite").parquet(posixpath.join(root, name + PLACES))


def read_task_map(spark: SparkSession, path: str) -> DataFrame:
    """(task_index, task) of a dataset, texts trimmed."""
    rows = spark.read.schema("task_index long, task string").json(posixpath.join(locate(path)[0], TASKS))
    return rows.filter("task_index is not null").select("task_index", F.trim(F.coalesce("task", F.lit(""))).alias("task"))
