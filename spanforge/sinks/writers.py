"""Writing results: documents, keyed summaries, logs, shards, caches. Spark's committer makes each write whole or not at all."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.intervals import contiguity
from spanforge.operators.tables import upsert

# The columns of the summary's CSV form.
SUMMARY = ("episode_index", "length", "template_key", "num_subtasks", "matched_manual_episode", "template_match_score", "mean_confidence", "boundaries", "annotation_path", "visualization_path")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts the folder `fresh` in the place of `path`; what was there goes only then."""
    jvm = spark._jvm.org.apache.hadoop.fs
    new, at, old = jvm.Path(fresh), jvm.Path(path), jvm.Path(path.rstrip("/") + ".old")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(old):
        store.delete(old, True)
    if store.exists(at):
        store.rename(at, old)
    if not store.rename(new, at):
        raise OSError(f"could not put {fresh} in the place of {path}")
    if store.exists(old):
        store.delete(old, True)


def write_annotations(docs: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Writes documents (episode_index, length, action_config, ...) as JSON lines; gives back the episodes that are wrong, of which none is written.

    An episode is right if its segments follow each other from 0 to its length. dry_run: checks only.
    """
    rows = docs.select("episode_index", F.explode("action_config").alias("s")).select("episode_index", "s.seg_id", "s.start_frame", "s.end_frame")
    wrong = contiguity(rows, docs.select("episode_index", "length"))
    if not dry_run:
        docs.join(wrong.select("episode_index"), "episode_index", "left_anti").write.mode("overwrite").json(path)
    return wrong


def write_summary(rows: DataFrame, path: str) -> DataFrame:
    """Puts rows in a summary kept as JSON, in place of those of the same episodes, and writes the same as CSV beside it. In order of episode_index."""
    spark, at, csv = rows.sparkSession, posixpath.join(path, "summary.json"), posixpath.join(path, "summary.csv")
    if exists(spark, at):
        old = spark.read.schema(rows.schema).json(at)
        rows = upsert(old, rows, ["episode_index"])
    ordered = rows.orderBy("episode_index")
    ordered.write.mode("overwrite").json(at + ".new")
    swap(spark, at + ".new", at)
    merged = spark.read.schema(rows.schema).json(at)
    held = [F.to_json(c).alias(c) if merged.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in SUMMARY if c in merged.columns]
    missing = [F.lit("").alias(c) for c in SUMMARY if c not in merged.columns]
    table = merged.select(*held, *missing).select(*SUMMARY)
    table.orderBy("episode_index").write.mode("overwrite").option("header", True).option("escape", '"').csv(csv)
    return merged.orderBy("episode_index")


def write_episode_files(frames: DataFrame, root: str, chunk: int) -> int:
    """Writes each episode's frames as root/chunk-<n>/episode_<index>.parquet, `chunk` episodes a folder, and says how many files there are.

    frames: (episode_index, ...); the files have the other columns, frames without an episode are left out. The tasks write the files, a batch of rows at a time, each under
    another name first, so that a task that fails or runs twice leaves no half of a file in the dataset.
    """

    def write(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem, LocalFileSystem

        store, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root.removeprefix("file:"))
        now = out = part = None
        made, files = set(), 0

        def close():
            out.close()
            store.move(part, f"{base}/chunk-{now // chunk:03d}/episode_{now:06d}.parquet")

        for b in batches:
            index = b.column("episode_index").to_numpy()
            rows = b.drop_columns(["episode_index"])
            edges = [0, *(index[1:] != index[:-1]).nonzero()[0] + 1, len(index)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if out is None or int(index[lo]) != now:
                    if out is not None:
                        close()
                    now, files = int(index[lo]), files + 1
                    folder = f"{base}/chunk-{now // chunk:03d}"
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    part = f"{folder}/.{uuid.uuid4().hex}.parquet"
                    out = pq.ParquetWriter(part, rows.schema, filesystem=store)
                out.write_batch(rows.slice(lo, hi - lo))
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    each = frames.filter("episode_index is not null").withColumn("episode_index", F.col("episode_index").cast("long"))
    counts = each.repartition("episode_index").sortWithinPartitions("episode_index").mapInArrow(write, "files long")
    return counts.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def append_records(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(path)


def rewrite_sorted(spark: SparkSession, path: str, schema: str, *order: str) -> DataFrame:
    """Reads JSON lines, leaves out what is no object, and writes the rest in order (of `index` where none is named) in the same place: each file is sorted, and the files follow each other."""
    order = order or ("index",)
    lines = spark.read.text(path)
    kept = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.schema_of_variant(F.try_parse_json("value")).alias("kind")).filter(F.startswith("kind", F.lit("OBJECT"))).select("r.*")
    kept.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path + ".new")
    swap(spark, path + ".new", path)
    return spark.read.schema(schema).json(path)


def written_places(rows: DataFrame, name: str = "place") -> DataFrame:
    """rows as read from files, with their number from 1: by file name, then by place in the file, however the files are split to be read."""
    from spanforge.operators.ordering import numbered

    at = ["__file", "__block", "__row"]
    lying = rows.select("*", F.col("_metadata.file_name").alias(at[0]), F.col("_metadata.file_block_start").alias(at[1]), F.monotonically_increasing_id().alias(at[2]))
    return numbered(lying, [F.col(c) for c in at], name).withColumn(name, F.col(name) + 1).drop(*at)


def merge_shards(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of the shards that exist, with their rank; blank lines count for nothing."""
    there = [(i, p) for i, p in enumerate(paths) if exists(spark, p)]
    found = [spark.read.schema(schema).json(p).withColumn("rank", F.lit(i)) for i, p in there]
    out = found[0] if found else spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def mark_processed(done: DataFrame, path: str, key: str = "checkpoint") -> DataFrame:
    """Adds keys to the table of what was processed, once each with the time of the last write, and gives it back in order."""
    spark = done.sparkSession
    fresh = done.select(key).distinct().withColumn("updated_at", F.current_timestamp())
    if exists(spark, path):
        fresh = upsert(spark.read.parquet(path), fresh, [key])
    fresh.write.mode("overwrite").parquet(path + ".new")
    swap(spark, path + ".new", path)
    return spark.read.parquet(path).orderBy(key)


def not_processed(rows: DataFrame, path: str, key: str = "checkpoint") -> DataFrame:
    """rows whose key the table of what was processed doesn't have."""
    spark = rows.sparkSession
    return rows.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else rows


def cached(spark: SparkSession, root: str, key: dict, make, force: bool = False) -> DataFrame:
    """The table kept under root for these settings, made and written if it isn't there or `force` holds.

    make() gives the DataFrame. key, such as camera, stride and size, names the folder.
    """
    import hashlib
    import re

    text = "_".join(f"{k}-{v}" for k, v in sorted(key.items()))
    tag = re.sub(r"[^A-Za-z0-9_.-]+", "-", text).strip("-")[:96]
    path = posixpath.join(root, f"{tag}_{hashlib.md5(text.encode()).hexdigest()[:8]}")
    if force or not exists(spark, posixpath.join(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def trace_records(rows: DataFrame, session: str, order: str) -> DataFrame:
    """rows with step_id: 1, 2, ... in each session."""
    return rows.withColumn("step_id", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: under spark.checkpoint.dir, or a temporary one if all of Spark is in this process."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/spanforge-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there, for what several later steps use; `rows` says how many it has.

    Nothing of it is computed again, whatever reads it, also after executors are lost.
    """
    spark, seen, path = df.sparkSession, Observation(), scratch(df.sparkSession, name)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rows = (seen.get or {"rows": 0})["rows"]
    return out
