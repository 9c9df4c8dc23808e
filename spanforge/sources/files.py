"""Files of a dataset as tables: JSON in its layouts, episode parquet, listings, blobs, frame rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as tx

# Names of files and keys in a dataset.
LIST_KEYS = ("episodes", "data", "annotations")
EPISODE_FILE = r"episode_(\d+)\.(json|mp4|parquet)$"
VIDEO_FILES = r"(?i)\.(mp4|avi|mov|mkv|webm|m4v)$"
TASK_FALLBACK_FPS = {"agibot_subtask": 30.0, "galaxea_subtask": 30.0, "behavior_subtask": 30.0}
SIBLING_CAMERAS = {
    "observation.images.cam_high": ("observation.images.cam_left_wrist", "observation.images.cam_right_wrist"),
    "observation.images.head_rgb": ("observation.images.left_wrist_rgb", "observation.images.right_wrist_rgb"),
    "images.rgb.head": ("images.rgb.hand_left", "images.rgb.hand_right"),
}


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; blank lines count for nothing, a malformed one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document a file; an array gives a row for each element."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("json"))


def _elements(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    listed = [F.try_variant_get("v", p, "array<variant>") for p in ("$", *(f"$.{k}" for k in keys))]
    found = F.coalesce(*listed, F.raise_error(F.concat(F.lit("no list of rows in "), "file")))
    return whole.select("file", F.posexplode(found).alias("pos", "x")).select("file", F.col("pos").cast("long").alias("pos"), F.to_json("x").alias("json"))


def load_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(file, json): the rows of a .jsonl file, or of a JSON list, or of the first list under `episodes`, `data` or `annotations`; else an error."""
    if path.lower().endswith(".jsonl"):
        return _lines(spark, path)
    return _elements(spark, path, LIST_KEYS).select("file", "json")


def read_json_or_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, json): a JSON array if the file's first sign is [, else a row for each line; nothing for an empty file. One sign comes to the driver."""
    first = _lines(spark, path).limit(1).select(F.left("json", F.lit(1)).alias("sign")).collect()
    if first and first[0]["sign"] == "[":
        return _elements(spark, path, ()).select("file", "json")
    return _lines(spark, path)


def available(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has; an error if it has none."""
    some = [c for c in columns if c in df.columns]
    if not some:
        raise ValueError(f"none of {columns} in {df.columns}")
    return df.select(*some)


def column_matrix(df: DataFrame, column: str, kind: str = "float") -> Column:
    """A column of vectors as arrays of floats; a number is a vector of one."""
    if df.schema[column].dataType.typeName() == "array":
        return F.transform(column, lambda x: x.cast(kind))
    return F.array(F.col(column).cast(kind))


def list_files(spark: SparkSession, root: str, pattern: str = ".*", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files whose path the pattern finds; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).filter(F.regexp_like("path", F.lit(pattern)))


def episode_of(path: Column) -> Column:
    """The number in a file's name, null if it is no episode's."""
    return F.nullif(F.regexp_extract(path, EPISODE_FILE, 1), F.lit("")).cast("long")


def list_episodes(spark: SparkSession, root: str) -> DataFrame:
    """(episode_index, path) of a dataset's episode files, in order."""
    found = list_files(spark, root, EPISODE_FILE)
    return found.select(episode_of(F.col("path")).alias("episode_index"), "path").orderBy("episode_index", "path")


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """The frames of all episodes, with the episode that their file's name gives."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "episode_*.parquet").parquet(root)
    return rows.withColumn("episode_index", episode_of(F.col("_metadata.file_path")))


def list_tasks(paths: DataFrame, root: str) -> DataFrame:
    """(prefix, task): the folders right under root that hold anything, and their names as tasks."""
    name = F.regexp_extract("path", r"\Q" + root.rstrip("/") + r"\E/([^/]+)/", 1)
    return paths.select(name.alias("prefix")).filter("prefix <> ''").distinct().select("prefix", tx.task_from_name(F.col("prefix")).alias("task")).orderBy("prefix")


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of files in any store that Spark reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def info_candidates(data_path: Column, task: Column | None = None) -> Column:
    """Where a dataset's info.json may be, in order: in its folder or beside it, or, if there is a task, in the task's folder first."""
    root = F.rtrim(data_path, F.lit("/"))
    near = [root, F.regexp_replace(root, "/[^/]*$", "")] if task is None else [F.concat_ws("/", root, task), root]
    return F.array(*[F.concat(p, F.lit(s)) for p in near for s in ("/meta/info.json", "/info.json")])


def info_fps(info: Column) -> Column:
    """The rate that an info.json names: its own, else that of the first feature with one."""
    own = F.get_json_object(info, "$.fps").try_cast("double")
    features = F.map_values(F.from_json(F.get_json_object(info, "$.features"), "map<string,string>"))
    rate = lambda x: F.coalesce(*[F.get_json_object(x, f"$.{k}['video.fps']").try_cast("double") for k in ("video_info", "info")])
    return F.coalesce(own, F.get(F.filter(F.transform(features, rate), lambda x: x.isNotNull()), F.lit(0)))


def resolve_fps(own: Column, infos: Column, default: Column | None = None, first_readable: bool = False) -> Column:
    """An episode's own rate, else that of the info files (an array of texts in order, null where there is none), else default, else an error.

    first_readable: only the first file that can be read counts."""
    readable = F.filter(infos, lambda x: F.try_parse_json(x).isNotNull())
    rates = F.filter(F.transform(F.slice(readable, 1, 1) if first_readable else readable, info_fps), lambda x: x.isNotNull())
    last = F.raise_error(F.lit("no frame rate: add fps to the episode or an info.json")) if default is None else default
    return F.coalesce(own.cast("double"), F.get(rates, F.lit(0)), last)


def fallback_fps(dataset: Column) -> Column:
    """The rate of a family of datasets that is known by name, else null."""
    return F.coalesce(*[F.when(F.contains(F.lower(dataset), F.lit(k)), F.lit(v)) for k, v in TASK_FALLBACK_FPS.items()])


def with_infos(datasets: DataFrame, infos: DataFrame, candidates: Column) -> DataFrame:
    """datasets with `infos`, the texts of their candidates in order. infos: (path, text), of the info.json files there are."""
    each = datasets.withColumn("__id", F.monotonically_increasing_id()).withColumn("__c", candidates)
    one = each.select("__id", F.posexplode("__c").alias("__pos", "path")).join(infos.select("path", "text"), "path", "left")
    texts = one.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "text"))), lambda x: x["text"]).alias("infos"))
    return each.join(texts, "__id").drop("__id", "__c")


def lookup_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")


def of_episode(path: Column, episode: int) -> Column:
    """How well a path names an episode: 0 by `episode` or `ep` and its padded number, 1 by the number alone, else null."""
    low, eight, six = F.lower(path), f"{episode:08d}", f"{episode:06d}"
    strict, loose = rf"ep(?:isode)?[_-]?(?:{eight}|{six})(?:\D|$)", rf"(?:^|\D)(?:{eight}|{six}|{episode})(?:\D|$)"
    return F.when(F.regexp_like(low, F.lit(strict)), 0).when(F.regexp_like(low, F.lit(loose)), 1)


def discover_videos(paths: DataFrame, keys: list[str], episode: int | None = None) -> DataFrame:
    """(key, path, issue): each camera key's video among the files in `path`.

    A key is known by its letters and digits, whole or after its last dot. A path that has it as a part or as its file's name
    beats one that only contains it. issue is null, `missing`, `ambiguous_exact` or `ambiguous_fuzzy`; path is null unless it is null.
    """
    files = paths.select("path").filter(F.regexp_like("path", F.lit(VIDEO_FILES))).distinct()
    if episode is not None:
        ranked = files.withColumn("__r", of_episode(F.col("path"), episode)).filter("__r is not null")
        files = ranked.join(ranked.agg(F.min("__r").alias("__m")), F.col("__r") == F.col("__m")).select("path")
    wanted = paths.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    return _settled(wanted.join(_by_key(files, keys), "key", "left"))


def _by_key(files: DataFrame, keys: list[str], *group: str) -> DataFrame:
    """(group, key, tier, one, n): the best form in which any path names the key, the first such path and how many there are."""
    parts = F.transform(F.split("path", "/"), lookup_token)
    stem = lookup_token(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    named = files.select(*group, "path", parts.alias("parts"), stem.alias("stem"), F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    tier = F.lit(None).cast("int")
    for c in (lookup_token(F.regexp_extract("key", r"([^.]*)$", 1)), lookup_token(F.col("key"))):
        exact = (F.col("stem") == c) | F.array_contains("parts", c)
        tier = F.when(c == "", tier).when(exact, 0).when(F.contains(F.array_join("parts", ""), c), 1).otherwise(tier)
    each = named.withColumn("tier", tier).filter("tier is not null").groupBy(*group, "key", "tier").agg(F.min("path").alias("one"), F.count_distinct("path").alias("n"))
    return each.groupBy(*group, "key").agg(F.min(F.struct("tier", "one", "n")).alias("b")).select(*group, "key", "b.*")


def _settled(found: DataFrame, *group: str) -> DataFrame:
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, F.when(F.col("tier") == 0, "ambiguous_exact").otherwise("ambiguous_fuzzy"))
    return found.select(*group, "key", F.when(issue.isNull(), F.col("one")).alias("path"), issue.alias("issue"))


def discover_each(paths: DataFrame, keys: list[str], episodes: DataFrame) -> DataFrame:
    """(episode_index, key, path, issue): `discover_videos` for every episode at once.

    Each file goes to the episodes that the numbers in its path may mean, by strict and loose forms; an episode takes the better form's files. So files meet episodes by number, not each
    other. episodes: (episode_index).
    """
    files = paths.select("path").filter(F.regexp_like("path", F.lit(VIDEO_FILES))).distinct()
    low = F.lower("path")
    strict = F.regexp_extract_all(low, F.lit(r"ep(?:isode)?[_-]?(\d{8}|\d{6})(?!\d)"), F.lit(1))
    loose = F.filter(F.regexp_extract_all(low, F.lit(r"\d+"), F.lit(0)), lambda n: F.length(n).isin(6, 8) | ~F.startswith(n, F.lit("0")) | (n == "0"))
    named = lambda found, rank: F.transform(F.array_distinct(F.transform(found, lambda n: n.cast("long"))), lambda n: F.struct(n.alias("episode_index"), F.lit(rank).alias("rank")))
    each = files.select("path", F.inline(F.concat(named(strict, 0), named(loose, 1)))).filter("episode_index is not null").groupBy("path", "episode_index").agg(F.min("rank").alias("rank"))
    each = each.join(episodes.select("episode_index").distinct(), "episode_index", "left_semi")
    best = each.groupBy("episode_index").agg(F.min("rank").alias("least"))
    some = each.join(best, "episode_index").filter("rank = least").select("episode_index", "path")
    found = _by_key(some, keys, "episode_index")
    wanted = episodes.select("episode_index").distinct().select("episode_index", F.explode(F.array(*[F.lit(k) for k in dict.fromkeys(keys)])).alias("key"))
    return _settled(wanted.join(found, ["episode_index", "key"], "left"), "episode_index")


def sibling_views(heads: DataFrame, files: DataFrame) -> DataFrame:
    """(path, view, view_path): a head camera's video and those of the wrists beside it that exist; view is head, left or right.

    Wrist cameras are known by a table of names, else they are the first folders by name with `left` or `right` and `wrist` in it.
    """
    h = heads.select("path", F.regexp_extract("path", "^(.*)/([^/]+)/([^/]+)$", 1).alias("root"), F.regexp_extract("path", "^(.*)/([^/]+)/([^/]+)$", 2).alias("camera"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    f = files.select(F.col("path").alias("file"), F.regexp_extract("path", "^(.*)/([^/]+)/([^/]+)$", 1).alias("root"), F.regexp_extract("path", "^(.*)/([^/]+)/([^/]+)$", 2).alias("folder"))
    low = F.lower("folder")
    side = lambda s: F.min(F.when(F.contains(low, F.lit(s)) & F.contains(low, F.lit("wrist")), F.col("folder"))).alias(s)
    near = f.groupBy("root").agg(side("left"), side("right"))
    names = F.create_map(*[x for k, v in SIBLING_CAMERAS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("camera")]
    h = h.join(near, "root", "left").withColumn("views", F.coalesce(names, F.array("left", "right")))
    each = h.select("path", "root", "name", F.posexplode("views").alias("at", "folder")).filter("folder is not null")
    each = each.select("path", F.when(F.col("at") == 0, "left").otherwise("right").alias("view"), F.concat_ws("/", "root", "folder", "name").alias("view_path"))
    there = each.join(f.select(F.col("file").alias("view_path")).distinct(), "view_path", "left_semi").select("path", "view", "view_path")
    return heads.select("path", F.lit("head").alias("view"), F.col("path").alias("view_path")).unionByName(there)


def list_videos(videos: DataFrame, annotations: DataFrame) -> DataFrame:
    """(name, episode_index, length, annotated): video files by name, and whether the episode has an annotation file. Both: (path, length)."""
    done = annotations.select(episode_of(F.col("path")).alias("episode_index")).filter("episode_index is not null").distinct().withColumn("__a", F.lit(True))
    v = videos.select(F.element_at(F.split("path", "/"), -1).alias("name"), episode_of(F.col("path")).alias("episode_index"), "length").filter(safe_name(F.col("name")))
    return v.join(done, "episode_index", "left").select("name", "episode_index", "length", F.coalesce("__a", F.lit(False)).alias("annotated")).orderBy("name")


def safe_name(name: Column) -> Column:
    """Whether a name is that of an episode's video and no path."""
    return F.regexp_like(name, F.lit(r"^episode_\d+\.mp4$"))
