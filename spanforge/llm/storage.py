"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and all of Spark is in this process (as in tests) a temporary one, the same for the whole application."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spanforge-")
        _OWN[app] = path
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage.

    The table's `seen` has how many `rows` were written, and of how many of them each condition in counts holds.

    Lost executors cost nothing that is already written, and values that depend
    on how rows were dealt out (partition numbers, row positions) are fixed. The
    shuffle files of the write go when it has ended. The list of its files goes with the
    table; Spark's cache would keep it on the driver, up to 250 MB of those of tables long gone.
    """
    spark, seen = df.sparkSession, Observation()
    path = fresh_path(spark, name)
    with _setting(spark, CLEANUP, "true"):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]).write.parquet(path)
    with _setting(spark, LISTINGS, "0"):
        out = spark.read.schema(df.schema).parquet(path)
    out.stored_at, out.seen = path, seen.get or {"rows": 0, **dict.fromkeys(counts, 0)}
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(table: DataFrame, cells: int = 3_000_000, of: DataFrame | None = None) -> DataFrame:
    """table, to be broadcast if it has at most `cells` values (of 8 bytes, say) in all; beyond that Spark joins it by a shuffle. of: a materialised table that has at least as many rows."""
    most, known = cells // len(table.columns), table.__dict__.get("seen") or (of.__dict__.get("seen") if of is not None else None)
    rows = known["rows"] if known else table.limit(most + 1).count()
    return F.broadcast(table) if rows <= most else table


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
