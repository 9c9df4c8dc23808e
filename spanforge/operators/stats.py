"""Statistics that templates are fitted from. Vectors are arrays; long tables have one row for each dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.tables import SMALL_CELLS, small

FLOOR = 1e-4


def by_dimension(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def gaussian_fit(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Mean and population variance, floored, of each dimension for each key."""
    return by_dimension(rows, vector, *keys).groupBy(*keys, "dim").agg(F.avg("x").alias("mean"), F.greatest(F.var_pop("x"), F.lit(FLOOR)).alias("var"))


def zscores(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, dim, z): values standardised over all rows; the parameters, a row for each dimension, go to all tasks."""
    long = by_dimension(rows, vector, key)
    params = long.groupBy("dim").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(FLOOR)).alias("s"))
    return long.join(small(params), "dim").select(key, "dim", ((F.col("x") - F.col("m")) / F.col("s")).alias("z"))


def gaussian_cost(rows: DataFrame, vector: str, key: str, model: DataFrame, on: str) -> DataFrame:
    """(key, on, cost): mean over dimensions of the negative log likelihood, without its constant."""
    long = by_dimension(rows, vector, key)
    one = long.join(small(model), "dim")
    cost = 0.5 * ((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")) / F.col("var") + F.ln("var"))
    return one.groupBy(key, on).agg(F.avg(cost).alias("cost"))


def descriptor_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors by the root of their length."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def nearest(targets: DataFrame, models: DataFrame, weight: float = 0.5, cells: int = SMALL_CELLS, most: int = 4096) -> DataFrame:
    """(id, model, score): each target's nearest model, the smaller id of equal ones.

    targets: (id, v, length); models: (model, mv, mlength), of episodes labelled by hand. Models are dealt into parts of about `cells` values and targets into groups of
    about `most`, by hash; each group meets each part once, and of its targets' best models the best stays. Vectors of unequal length don't meet.
    """
    count, size = models.agg(F.count(F.lit(1)), F.max(F.size("mv"))).first()
    parts, groups = max(1, -(-count * (size or 1) // cells)), max(1, -(-targets.count() // most))
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1)).cast("double"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    key = ["__group", "__part", "__size"]
    left = targets.filter("v is not null").select("id", F.col("v").cast("array<double>").alias("v"), log("length").alias("l"), deal("id", groups).alias(key[0]), F.size("v").alias(key[2])).withColumn(key[1], every(parts))
    right = models.filter("mv is not null").select("model", F.col("mv").cast("array<double>").alias("v"), log("mlength").alias("l"), deal("model", parts).alias(key[1]), F.size("mv").alias(key[2])).withColumn(key[0], every(groups))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        if not (a.num_rows and b.num_rows):
            return pa.table([a.column("id").slice(0, 0), b.column("model").slice(0, 0), pa.array([], pa.float64())], ["id", "model", "score"])
        vectors = lambda t: pc.list_flatten(t.column("v")).to_numpy().reshape(t.num_rows, -1)
        b = b.take(pc.sort_indices(b, [("model", "ascending")]))
        best, found = best_models(vectors(a), a.column("l").to_numpy(), vectors(b), b.column("l").to_numpy(), weight)
        return pa.table([a.column("id"), b.column("model").take(pa.array(found)), pa.array(best)], ["id", "model", "score"])

    schema = f"id {dict(targets.dtypes)['id']}, model {dict(models.dtypes)['model']}, score double"
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)
    return found.groupBy("id").agg(F.min(F.struct("score", "model")).alias("best")).select("id", "best.model", "best.score")


def best_models(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray, weight: float, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(score, row of y) of the best row of y, the first of equal ones, for each row of x: their distance by the root of their length, and weight times the difference of lx and ly.

    Rows of y are met in the order of ly outwards from a block of x, until that difference alone exceeds every best score in the block.
    """
    best, found = np.full(len(x), np.inf), np.zeros(len(x), "i8")
    order, place = np.argsort(lx, kind="stable"), np.argsort(ly, kind="stable")
    chunks = [np.sort(place[i : i + rows]) for i in range(0, len(place), rows)]
    low, high = np.array([ly[c].min() for c in chunks]), np.array([ly[c].max() for c in chunks])
    for i in range(0, len(order), rows):
        own = order[i : i + rows]
        score, at = np.full(len(own), np.inf), np.full(len(own), len(y))
        gaps = weight * np.maximum(0.0, np.maximum(low - lx[own].max(), lx[own].min() - high))
        for c in np.argsort(gaps, kind="stable"):
            if gaps[c] > score.max() + 1e-9:
                break
            m, squares = chunks[c], 0.0
            for d in range(x.shape[1]):
                squares = squares + (x[own, d][:, None] - y[m, d][None, :]) ** 2
            cost = np.sqrt(squares / x.shape[1]) + weight * np.abs(lx[own][:, None] - ly[m][None, :])
            cost = np.where(np.isnan(cost), np.inf, cost)
            k = cost.argmin(axis=1)
            new, row = cost[np.arange(len(own)), k], m[k]
            less = (new < score) | ((new == score) & (row < at))
            score, at = np.where(less, new, score), np.where(less, row, at)
        best[own], found[own] = score, at
    return best, found


def ratio_priors(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """For each template (number of segments) and place: median start, median and least length, as parts of the episode."""
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    s = segments.withColumn("template", n).join(episodes.select("episode_index", "length"), "episode_index")
    start, part = F.col("start_frame") / F.col("length"), (F.col("end_frame") - F.col("start_frame")) / F.col("length")
    return s.groupBy("template", "seg_id").agg(F.median(start).alias("start"), F.median(part).alias("part"), F.min(part).alias("least"))


def mode_nonempty(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The most frequent non-empty text of each key, of equally frequent ones that seen first."""
    some = rows.filter(F.trim(text) != "").groupBy(key, text).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return some.groupBy(key).agg(F.min_by(text, F.struct(-F.col("n"), F.col("first"))).alias("mode"), F.max("n").alias("n"))


def robust01(rows: DataFrame, x: str, key: str) -> DataFrame:
    """Adds `scaled`: 0 at the 5th and 1 at the 95th percentile of the key, clipped."""
    p = rows.groupBy(key).agg(F.percentile(x, F.array(F.lit(0.05), F.lit(0.95))).alias("__p"))
    scaled = (F.col(x) - F.col("__p")[0]) / F.greatest(F.col("__p")[1] - F.col("__p")[0], F.lit(1e-6))
    return rows.join(p, key).withColumn("scaled", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).drop("__p")


def percentile_scale(rows: DataFrame, x: str, key: str, q: float = 0.9) -> DataFrame:
    """Adds `scaled`: x by the key's q-quantile (by 1e-6 where that is smaller)."""
    p = rows.groupBy(key).agg(F.percentile(x, F.lit(q)).alias("__p"))
    return rows.join(p, key).withColumn("scaled", F.col(x) / F.greatest("__p", F.lit(1e-6))).drop("__p")


def histogram(rows: DataFrame, x: str, lo: float, hi: float, bins: int, *keys: str) -> DataFrame:
    """(keys, bin, part): parts of the values in equal bins; the last holds the upper bound."""
    b = F.least(F.greatest(F.floor((F.col(x) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("long")
    n = rows.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")
