"""Features of episodes: of a robot's states and of what its cameras see.

States: (episode_index, frame_index, columns). Videos: (episode_index, frame_index, camera, pixels, width, height), pixels RGB bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.images import features_of, gray_of, motion_between
from spanforge.operators.sequence import in_order, moving_average, temporal_context, vector_difference
from spanforge.operators.stats import robust01
from spanforge.sources.files import available, column_matrix


@dataclass(frozen=True)
class Settings:
    state_offsets: tuple[int, ...] = (-20, -10, -5, 0, 5, 10, 20)
    visual_offsets: tuple[int, ...] = (-2, -1, 0, 1, 2)  # of sampled frames
    smooth: int = 17
    stride: int = 5
    size: tuple[int, int] = (64, 48)
    state_weight: float = 0.45
    visual_weight: float = 0.55


def with_differences(rows: DataFrame, vector: str) -> DataFrame:
    """Adds d1 and d2, first and second differences (zeros at the start), and motion, the length of d1."""
    d1, size = vector_difference(vector)
    once = rows.withColumn("d1", d1).withColumn("motion", size)
    return once.withColumn("d2", vector_difference("d1")[0])


def context_vector(offsets: tuple[int, ...]) -> Column:
    """Value, d1 and d2 at the offsets, one after the other."""
    return F.concat(*temporal_context("base", offsets))


def state_features(frames: DataFrame, columns: list[str], s: Settings = Settings()) -> DataFrame:
    """(episode_index, frame_index, state, state_motion) from those of the columns that there are; an error if there are none."""
    some = available(frames, columns).columns
    vector = F.concat(*[column_matrix(frames, c, "double") for c in some])
    rows = with_differences(frames.select("episode_index", "frame_index", vector.alias("v")), "v").withColumn("base", F.concat("v", "d1", "d2"))
    return rows.select("episode_index", "frame_index", context_vector(s.state_offsets).alias("state"), moving_average("motion", s.smooth).alias("state_motion"))


def whole_frames(videos: DataFrame, cameras: list[str]) -> DataFrame:
    """The rows of frames that all cameras have, up to the first that one of them lacks."""
    some = videos.filter(F.col("camera").isin(cameras))
    ends = some.groupBy("episode_index", "camera").agg(F.max("frame_index").alias("last"), F.count(F.lit(1)).alias("n"))
    shortest = ends.groupBy("episode_index").agg(F.min("last").alias("__last"), F.count(F.lit(1)).alias("__cameras")).filter(F.col("__cameras") == len(cameras))
    return some.join(shortest.select("episode_index", "__last"), "episode_index").filter(F.col("frame_index") <= F.col("__last")).drop("__last")


def visual_motion(videos: DataFrame, cameras: list[str], s: Settings = Settings()) -> DataFrame:
    """(episode_index, frame_index, visual_motion): change of gray from frame to frame, mean of the cameras, smoothed."""
    g = whole_frames(videos, cameras).select("episode_index", "frame_index", "camera", gray_of(F.col("pixels"), F.col("width"), F.col("height"), s.size).alias("g"))
    g = g.withColumn("before", F.lag("g").over(in_order("camera")))
    one = g.select("episode_index", "frame_index", motion_between(F.col("g"), F.col("before")).alias("m")).groupBy("episode_index", "frame_index").agg(F.avg("m").alias("m"))
    return one.select("episode_index", "frame_index", moving_average("m", s.smooth).alias("visual_motion"))


def visual_features(videos: DataFrame, cameras: list[str], s: Settings = Settings()) -> DataFrame:
    """(episode_index, frame_index, visual) of every stride-th frame: all cameras' features in their order, with differences and context."""
    rows = whole_frames(videos, cameras).filter(F.pmod("frame_index", F.lit(s.stride)) == 0)
    place = F.array_position(F.array(*map(F.lit, cameras)), F.col("camera"))
    f = rows.select("episode_index", "frame_index", place.alias("place"), features_of(F.col("pixels"), F.col("width"), F.col("height"), s.size).alias("f"))
    one = f.groupBy("episode_index", "frame_index").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "f"))), lambda x: x["f"])).alias("v"))
    one = with_differences(one, "v").withColumn("base", F.concat("v", "d1", "d2"))
    return one.select("episode_index", "frame_index", context_vector(s.visual_offsets).alias("visual"))


def combine_motion(state: DataFrame, visual: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(episode_index, frame_index, motion) of the frames that both have: weighted sum of both scaled to 0 to 1 by episode."""
    both = state.select("episode_index", "frame_index", "state_motion").join(visual.select("episode_index", "frame_index", "visual_motion"), ["episode_index", "frame_index"])
    a = robust01(both, "state_motion", "episode_index").withColumnRenamed("scaled", "__s")
    b = robust01(a, "visual_motion", "episode_index")
    return b.select("episode_index", "frame_index", (s.state_weight * F.col("__s") + s.visual_weight * F.col("scaled")).alias("motion"))


def episode_features(frames: DataFrame, columns: list[str], videos: DataFrame, cameras: list[str], s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(samples, motion): (episode_index, frame_index, state, visual) of sampled frames, (episode_index, frame_index, motion) of all; both as long as the shorter of states and video."""
    state = state_features(frames, columns, s)
    samples = visual_features(videos, cameras, s).join(state.select("episode_index", "frame_index", "state"), ["episode_index", "frame_index"])
    return samples.select("episode_index", "frame_index", "state", "visual"), combine_motion(state, visual_motion(videos, cameras, s), s)


def by_modality(rows: DataFrame, keys: list[str], modalities: tuple[str, ...] = ("state", "visual")) -> DataFrame:
    """(keys, modality, dim, x): a row for each number of the vectors; modality is the vector's place."""
    named = lambda k: lambda x, i: F.struct(F.lit(k).alias("modality"), i.alias("dim"), x.cast("double").alias("x"))
    return rows.select(*keys, F.inline(F.concat(*[F.transform(m, named(k)) for k, m in enumerate(modalities)])))


def descriptors(samples: DataFrame, lengths: DataFrame) -> DataFrame:
    """(episode_index, length, v): log length, and mean and deviation of each dimension of state and visual, in order."""
    one = by_modality(samples, ["episode_index"]).groupBy("episode_index", "modality", "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    both = one.select("episode_index", F.inline(F.array(*[F.struct((2 * F.col("modality") + k).alias("part"), "dim", F.col(x).alias("x")) for k, x in enumerate("md")])))
    listed = both.groupBy("episode_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "dim", "x"))), lambda r: r["x"]).alias("__v"))
    return listed.join(lengths.select("episode_index", "length"), "episode_index").select("episode_index", "length", F.concat(F.array(F.log1p("length")), "__v").alias("v"))


def standardised(rows: DataFrame, vector: str, floor: float = 1e-4) -> DataFrame:
    """rows with the vector standardised over all rows, dimension by dimension; the parameters are one row."""
    long = rows.select(F.posexplode(vector).alias("dim", "x"))
    one = long.groupBy("dim").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("s"))
    p = one.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("__p"))
    z = F.zip_with(vector, "__p", lambda x, q: (x - q["m"]) / q["s"])
    return rows.join(F.broadcast(p)).withColumn(vector, z).drop("__p")  # one row of as many values as a vector has


def last_frames(motion: DataFrame) -> DataFrame:
    """(episode_index, length) of tables of all frames."""
    return motion.groupBy("episode_index").agg((F.max("frame_index") + 1).alias("length"))
