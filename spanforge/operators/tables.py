"""Scans' clean-up, look-ups, as-of and range joins, set operations and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and values (of lists each item) up to which a look-up table is sent to all tasks; larger ones are joined by Spark's own choice.
SMALL_ROWS, SMALL_CELLS = 200_000, 4_000_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows and SMALL_CELLS values, texts counting by 8 bytes; both are counted."""
    cells = lambda f: F.size(f.name) if f.dataType.typeName() == "array" else F.octet_length(f.name) / 8 if f.dataType.typeName() in ("string", "binary") else F.lit(1)
    each = sum((F.greatest(F.coalesce(cells(f), F.lit(0)), F.lit(1)) for f in df.schema.fields), F.lit(0))
    rows, values = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and values <= SMALL_CELLS else df


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregated before the shuffle, so a frequent key costs one row a task."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order)) if order else F.last(F.struct(*others))
    return rows.groupBy(*keys).agg(last.alias("__r")).select(*keys, "__r.*")


def chunk_path(episode: Column, chunk: int) -> Column:
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(episode / chunk), episode)


def json_objects(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text is a JSON object; malformed ones and other values go."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(column)))
    return rows.filter(F.startswith(F.coalesce(kind, F.lit("")), F.lit("OBJECT")))


def tiered_match(rows: DataFrame, key: str, tests: list[Column], order: str) -> DataFrame:
    """(key, order, tier): the first row of the first test that any row of the key passes."""
    tier = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])
    some = rows.withColumn("tier", tier).filter("tier is not null")
    return some.groupBy(key).agg(F.min_by(order, F.struct("tier", order)).alias(order), F.min("tier").alias("tier"))


def id_filter(c: Column, listed: str) -> Column:
    """Whether c is among the ids that end the items of a comma-separated list."""
    import re

    ids = [int(m[1]) for m in (re.search(r"(\d+)$", x.strip()) for x in listed.split(",")) if m]
    return c.isin(ids) if ids else F.lit(True)


def tagged(c: Column, tag: str) -> Column:
    return (c == tag) | F.endswith(c, F.lit("_" + tag))


def lookup(rows: DataFrame, key: str, names: DataFrame, name_key: str, value: str, missing: str) -> DataFrame:
    n = small(names.select(F.col(name_key).alias("__k"), value))
    return rows.join(n, rows[key] == n["__k"], "left").drop("__k").withColumn(value, F.coalesce(value, F.lit(missing)))


def exists_flag(rows: DataFrame, key: str, others: DataFrame, other_key: str, name: str) -> DataFrame:
    some = others.select(F.col(other_key).alias("__k")).distinct()
    return rows.join(some, rows[key] == some["__k"], "left").withColumn(name, F.col("__k").isNotNull()).drop("__k")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")


def select_targets(rows: DataFrame, key: str, gone: list[DataFrame], most: int | None = None, requested: DataFrame | None = None, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Keys of rows, or of what was requested if anything was, in none of the tables in gone, and not existing ones unless overwrite holds. In order; the first `most`, unless some were requested."""
    rows = (rows if requested is None else requested).select(key)
    for g in [*gone, *([existing] if existing is not None and not overwrite else [])]:
        rows = without(rows, g.select(key), [key])
    rows = rows.distinct().orderBy(key)
    return rows.limit(most) if most and requested is None else rows


def fill_missing(rows: DataFrame, column: str, key: str, sources: list[DataFrame], missing: int = -1) -> DataFrame:
    """column, from the first of rows and sources that has it."""
    values = [F.nullif(F.col(column), F.lit(missing))]
    for i, s in enumerate(sources):
        rows = rows.join(s.select(key, F.col(column).alias(f"__v{i}")), key, "left")
        values.append(F.nullif(F.col(f"__v{i}"), F.lit(missing)))
    return rows.withColumn(column, F.coalesce(*values)).drop(*[f"__v{i}" for i in range(len(sources))])


def offsets(rows: DataFrame, order: str, size: str, parts: int = 64) -> DataFrame:
    """Adds lo and hi, the range that each row's size takes when rows are laid end to end.

    Rows are dealt out by ranges of about as many rows each, so that no part of the order holds most of them, and sums are made within
    these; the ranges' own offsets are a table of `parts` rows. Equal keys stay in one range.
    """
    ends = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001) if rows.limit(1).count() else []
    cuts = sorted(set(ends))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    r = rows.withColumn("__p", part)
    sums = r.groupBy("__p").agg(F.sum(size).alias("__s"))
    base = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    w = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("__h", F.sum(size).over(w)).join(F.broadcast(base), "__p")
    return r.withColumn("hi", F.col("__o") + F.col("__h")).withColumn("lo", F.col("hi") - F.col(size)).drop("__p", "__h", "__o")


def locate(samples: DataFrame, at: str, ranges: DataFrame, bucket: int = 1024) -> DataFrame:
    """Each sample number with the row in whose range [lo, hi) it lies; both are dealt out by buckets of numbers."""
    r = ranges.filter("hi > lo").withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))))
    s = samples.withColumn("__b", F.floor(F.col(at) / bucket))
    return s.join(r, "__b").filter((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("__b")


def nearest_asof(probes: DataFrame, t: str, probe: str, stream: DataFrame, st: str, frame: str, key: str) -> DataFrame:
    """Each probe with the frame of its key nearest in time, the earlier of two equally near, the first of equal times.

    One sort of both tables together; no pairs are made.
    """
    p = probes.select(key, F.col(t).alias("__t"), F.lit(1).alias("__q"), probe, F.lit(None).cast("long").alias(frame))
    s = stream.groupBy(key, F.col(st).alias("__t")).agg(F.min(frame).alias(frame))
    both = s.select(key, "__t", F.lit(0).alias("__q"), F.lit(None).cast("long").alias(probe), frame).unionByName(p)
    seen = F.when(F.col("__q") == 0, F.struct("__t", frame))
    w = Window.partitionBy(key).orderBy("__t", "__q")
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    # equal times: the stream's row comes first, so `before` holds it
    m = both.withColumn("__a", before).withColumn("__z", after).filter("__q = 1")
    first = F.col("__z").isNull() | (F.col("__a").isNotNull() & (F.col("__t") - F.col("__a")["__t"] <= F.col("__z")["__t"] - F.col("__t")))
    return m.select(key, probe, F.when(first, F.col("__a")[frame]).otherwise(F.col("__z")[frame]).alias(frame))


def align_both(head: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Head frames with those of both wrists at the same part of their lengths, null where there are none, and how many views each has."""
    both = align_views(align_views(head, left), right)
    views = [c for c in both.columns if c in left.columns + right.columns and c not in ("episode_index", "i")]
    return both.withColumn("views", F.lit(1) + sum((F.col(c).isNotNull().cast("int") for c in views), F.lit(0)))


def align_views(head: DataFrame, wrist: DataFrame) -> DataFrame:
    """Each head frame i with the frame of another stream of the episode at the same part of its length, if there is one."""
    from spanforge.functions.score import scale_index

    m = wrist.groupBy("episode_index").agg(F.count(F.lit(1)).alias("__m"))
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    h = head.withColumn("__n", n).join(m, "episode_index", "left").withColumn("__w", scale_index(F.col("i"), F.col("__n"), F.col("__m")))
    w = wrist.withColumnRenamed("i", "__i").withColumnRenamed("episode_index", "__e")
    return h.join(w, (h["episode_index"] == w["__e"]) & (h["__w"] == w["__i"]), "left").drop("__e", "__i", "__n", "__m", "__w")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and old's whose keys new doesn't have."""
    return without(old, new.select(*keys), keys).unionByName(new)
