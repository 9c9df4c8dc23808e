"""Operators on ordered frames of an episode. Rows have episode_index and frame_index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sinks.writers import kept


def in_order(*more: str) -> Window:
    return Window.partitionBy("episode_index", *more).orderBy("frame_index")


def differences(x: str = "value") -> tuple[Column, Column]:
    """First difference, 0 at the start, and the difference of that."""
    w = in_order()
    d1 = F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0))
    before = F.when(F.lag(x).over(w).isNull(), None).otherwise(F.coalesce(F.lag(x).over(w) - F.lag(x, 2).over(w), F.lit(0.0)))
    return d1, F.coalesce(d1 - before, F.lit(0.0))


def vector_difference(x: str) -> tuple[Column, Column]:
    """Difference of a vector from the frame before (zeros at the start), and its length."""
    d = F.zip_with(x, F.coalesce(F.lag(x).over(in_order()), F.col(x)), lambda a, b: a.cast("double") - b)
    return d, F.sqrt(F.aggregate(F.transform(d, lambda v: v * v), F.lit(0.0), lambda a, v: a + v))


def moving_average(x: str = "value", width: int = 17) -> Column:
    """Centred mean over `width` frames, the first and last value repeated beyond the ends."""
    left, right = width // 2, width - 1 - width // 2
    w = in_order()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    before, after = F.greatest(F.lit(0), F.lit(left) - i), F.greatest(F.lit(0), i + right - (n - 1))
    total = F.sum(x).over(w.rowsBetween(-left, right)) + before * F.first(x).over(whole) + after * F.last(x).over(whole)
    return total / F.lit(width)


def temporal_context(x: str, offsets: tuple[int, ...]) -> list[Column]:
    """Values at offsets from each frame, clipped to the episode."""
    w = in_order()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda k: F.col(x) if k == 0 else F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w)
    return [F.coalesce(at(k), (F.first(x) if k < 0 else F.last(x)).over(whole)) for k in offsets]


def local_minima(rows: DataFrame, x: str, lo: int, hi: Column) -> DataFrame:
    """Frames in lo + 1 .. hi - 1 that are not above either neighbour."""
    w = in_order()
    near = rows.withColumn("__p", F.lag(x).over(w)).withColumn("__n", F.lead(x).over(w))
    return near.filter((F.col(x) <= F.col("__p")) & (F.col(x) <= F.col("__n")) & (F.col("frame_index") > lo) & (F.col("frame_index") < hi)).drop("__p", "__n")


def prefix_sum(x: str) -> Column:
    return F.sum(x).over(in_order().rowsBetween(Window.unboundedPreceding, 0))


def stride_cap(episodes: DataFrame, most: int, fps: float) -> DataFrame:
    """At most `most` frames an episode at an even stride, and the rate that leaves."""
    step = F.greatest(F.lit(1), F.ceil(F.col("length") / most)).cast("long")
    frames = F.slice(F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)), 1, most)
    return episodes.select("episode_index", step.alias("step"), (F.lit(fps) / step).alias("fps"), F.explode(frames).alias("frame_index"))


def interval_sample(rows: DataFrame, every: int, start: int = 0, last: bool = True) -> DataFrame:
    hit = (F.col("frame_index") >= start) & (F.pmod(F.col("frame_index") - start, F.lit(every)) == 0)
    end = F.lead("frame_index").over(in_order()).isNull()
    return rows.withColumn("__h", (hit | end) if last else hit).filter("__h").drop("__h")


def greedy_gap(rows: DataFrame, at: str, gap: float) -> DataFrame:
    """(episode_index, frame_index) of frames at least `gap` after the last one taken, the first taken always. Frames without a time aren't taken.

    A taken frame is later in time than all before it, so only such frames count, and each points to the first that is `gap` later.
    The frames on the way from an episode's first are found by doubling: what is reached in 2^k steps, and pointers over 2^k steps, give
    those of 2^(k+1); so there are as many rounds as the logarithm of what one episode takes, and no episode's frames are held together.
    """
    w = in_order()
    times = rows.select("episode_index", "frame_index", F.col(at).cast("double").alias("t")).dropna()
    before = F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1))
    records = kept(times.withColumn("b", before).filter("b is null or t > b").select("episode_index", "frame_index", "t", F.col("b").isNull().alias("first")), "records")
    both = records.select("episode_index", "t", F.lit(0).alias("asks"), "frame_index").unionByName(records.select("episode_index", (F.col("t") + gap).alias("t"), F.lit(1).alias("asks"), "frame_index"))
    later = F.last(F.when(F.col("asks") == 0, F.col("frame_index")), ignorenulls=True).over(Window.partitionBy("episode_index").orderBy(F.desc("t"), "asks").rowsBetween(Window.unboundedPreceding, 0))
    step = kept(both.withColumn("to", later).filter("asks = 1 and to is not null").select("episode_index", F.col("frame_index").alias("from"), "to"), "steps")
    taken = records.filter("first").select("episode_index", "frame_index")
    while step.rows:
        on = lambda x, y: [x["episode_index"] == y["episode_index"], x["frame_index"] == y["from"]]
        reached = kept(taken.join(step, on(taken, step)).select(taken["episode_index"], F.col("to").alias("frame_index")), "reached")
        if not reached.rows:
            break
        taken = taken.unionByName(reached)
        next_ = step.select("episode_index", F.col("from").alias("to"), F.col("to").alias("after"))
        step = kept(step.join(next_, ["episode_index", "to"]).select("episode_index", "from", F.col("after").alias("to")), "steps")
    return taken


def memory_chain(rows: DataFrame, initial: str, *parts: str) -> DataFrame:
    """Adds memory_in, the last prediction before each step (of its episode and parts) that is not empty and not skipped, and memory_out."""
    w = Window.partitionBy("episode_index", *parts).orderBy("sample_id")
    said = F.when(~F.coalesce("skip", F.lit(False)), F.nullif(F.trim("pred"), F.lit("")))
    given = F.coalesce(F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(initial))
    return rows.withColumn("memory_in", given).withColumn("memory_out", F.coalesce(said, F.col("memory_in")))


def round_robin(rows: DataFrame, workers: int) -> DataFrame:
    """The worker of each of an episode's frames in turn."""
    return rows.withColumn("worker", F.pmod(F.row_number().over(in_order()) - 1, F.lit(workers)).cast("long"))


def sliding_p80(values: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The 80th percentile (between neighbours linearly) and minimum of each value's window of `half` on either side; nan doesn't count and stands where a window has no other."""
    held = np.concatenate([np.full(half, np.inf), np.where(np.isnan(values), np.inf, values), np.full(half, np.inf)])
    out = np.full((2, len(values)), np.nan)
    for i in range(0, len(values), 4096):
        part = np.sort(np.lib.stride_tricks.sliding_window_view(held[i : i + 4096 + 2 * half], 2 * half + 1), axis=1)
        n, row = np.isfinite(part).sum(axis=1), np.arange(len(part))
        at = 0.8 * np.maximum(n - 1, 0)
        lo, hi = np.floor(at).astype("i8"), np.ceil(at).astype("i8")
        a, b = part[row, lo], part[row, hi]
        with np.errstate(invalid="ignore"):
            out[0, i : i + len(part)] = np.where(n == 0, np.nan, np.where(lo == hi, a, (hi - at) * a + (at - lo) * b))
        out[1, i : i + len(part)] = np.where(n == 0, np.nan, part[:, 0])
    return out[0], out[1]


def boundary_confidence(rows: DataFrame, x: str = "value", half: int = 90, chunk: int = 1 << 14) -> DataFrame:
    """How far each frame's motion lies below the window's 80th percentile, as a part of the way to its minimum: p80, low, pause.

    Windows count frames, not their numbers. An episode is cut into chunks that take along `half` frames from either side; each chunk is one task's work.
    """
    place = F.row_number().over(in_order()) - 1
    held = rows.withColumn("__i", place).withColumn("__c", F.explode(F.sequence(F.floor(F.greatest(F.col("__i") - half, F.lit(0)) / chunk), F.floor((F.col("__i") + half) / chunk))))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", p80 double, low double"

    def look(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        p80, low = sliding_p80(table.column(x).cast(pa.float64()).to_numpy(), half)
        mine = pa.array(table.column("__i").to_numpy() // chunk == table.column("__c").to_numpy())
        out = table.drop(["__i", "__c"]).append_column("p80", pa.array(p80, from_pandas=True)).append_column("low", pa.array(low, from_pandas=True))
        return out.filter(mine)

    found = held.groupBy("episode_index", "__c").applyInArrow(look, schema)
    pause = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("p80") - F.col(x)) / F.greatest(F.col("p80") - F.col("low"), F.lit(1e-6))))
    return found.withColumn("pause", pause)


def interval_means(samples: DataFrame, x: str, intervals: DataFrame) -> DataFrame:
    """(episode_index, seg_id, mean): mean of the samples in each interval, by differences of prefix sums; of the next sample from its middle on where it holds none.

    Samples with their prefix sums and the intervals' starts, middles and ends are put in one order; each of the latter reads off how many samples and what sum lie before it, and
    the next sample. So no interval meets a sample that it doesn't hold, and no episode's samples are one row.
    """
    rows = samples.select("episode_index", F.col("frame_index").cast("long").alias("at"), F.lit(1).alias("kind"), F.col(x).cast("double").alias("x"), F.lit(None).cast("long").alias("seg_id"), F.lit(None).cast("int").alias("end"))
    places = [F.col("start_frame"), F.floor((F.col("start_frame") + F.col("end_frame")) / 2), F.col("end_frame")]
    asks = intervals.select("episode_index", F.col("seg_id").cast("long").alias("seg_id"), F.posexplode(F.array(*[p.cast("long") for p in places])).alias("end", "at"))
    both = rows.unionByName(asks.withColumns({"kind": F.lit(0), "x": F.lit(None).cast("double")}))
    w = Window.partitionBy("episode_index").orderBy("at", "kind")  # an end comes before a sample of its own frame
    upto, rest = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("episode_index").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"n": F.count("x").over(upto), "p": F.coalesce(F.sum("x").over(upto), F.lit(0.0)), "next": F.last("x", ignorenulls=True).over(rest), "last": F.last("x", ignorenulls=True).over(upto)})
    one = lambda i, c: F.max(F.when(F.col("end") == i, F.col(c)))
    each = seen.filter("kind = 0").groupBy("episode_index", "seg_id").agg(*[one(i, c).alias(f"{c}{i}") for i in range(3) for c in ("n", "p")], one(1, "next").alias("next"), one(1, "last").alias("last"))
    held = F.when(F.col("n2") > F.col("n0"), (F.col("p2") - F.col("p0")) / (F.col("n2") - F.col("n0"))).otherwise(F.coalesce("next", "last"))
    return each.select("episode_index", "seg_id", held.alias("mean")).filter("mean is not null")
