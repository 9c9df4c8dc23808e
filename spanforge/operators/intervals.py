"""Frame intervals: construction, validation, rewriting and joins. Intervals are [start_frame, end_frame) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("transition", "uniform", "final_tail")


def of_episode() -> Window:
    return Window.partitionBy("episode_index").orderBy("seg_id")


def explode_segments(episodes: DataFrame) -> DataFrame:
    """One row for each element of action_config with its position; episodes without any give none."""
    return episodes.select("episode_index", F.posexplode("action_config").alias("pos", "seg")).select("episode_index", F.col("pos").cast("long").alias("pos"), "seg.*")


def _frames(seconds: float, fps: Column, least: int) -> Column:
    return F.greatest(F.lit(least).cast("long"), F.ceil(F.lit(float(seconds)) * fps).cast("long"))


def sampling_windows(segments: DataFrame, cfg, fps: Column | None = None) -> DataFrame:
    """Windows around and inside every segment: (episode_index, seg_id, kind, target, memory, a, b, lo, hi, step).

    Before a boundary and after it lies a transition window, before an episode's end a tail, between them what is
    uniform; [a, b) is where the grid of steps is anchored, [lo, hi) what counts of it. Neighbours are
    those in the list of all segments; empty segments have no windows but count as neighbours.
    """
    if min(cfg.interleave, cfg.dense_step, cfg.tail_step) <= 0:
        raise ValueError("steps must be positive")
    fps = F.lit(float(cfg.fps)) if fps is None else fps.cast("double")
    w = of_episode()
    s = segments.select(
        "episode_index", "seg_id", F.col("start_frame").alias("s"), F.col("end_frame").alias("e"), F.lag("start_frame").over(w).alias("ps"), F.lead("seg_id").over(w).isNull().alias("last")
    ).filter("e > s")
    tail, head, end, ignore = _frames(cfg.tail_sec, fps, 1), _frames(cfg.head_sec, fps, 1), _frames(cfg.last_sec, fps, 1), _frames(cfg.ignore_sec, fps, 0)
    inner = F.col("ps").isNotNull()
    s = s.withColumn("tb", F.when(inner, F.least(F.col("e"), F.col("s") + head)))
    s = s.withColumn("ss", F.coalesce("tb", "s"))
    s = s.withColumn("se", F.greatest(F.col("ss"), F.col("e") - F.when(F.col("last"), end).otherwise(tail)))
    i = F.col("seg_id")

    def window(kind: str, on: Column, target: Column, memory: Column, a: Column, b: Column, lo: Column, hi: Column, step: int) -> Column:
        parts = dict(kind=F.lit(kind), target=target, memory=memory, a=a, b=b, lo=lo, hi=hi, step=F.lit(step).cast("long"))
        return F.when(on, F.struct(*[v.alias(k) for k, v in parts.items()]))

    ta = F.greatest(F.col("s") - tail, F.col("ps"))
    found = F.array(
        window("transition", inner, i, i - 1, ta, F.col("tb"), ta, F.col("tb"), cfg.dense_step),
        window("uniform", F.lit(True), i, i, F.col("ss"), F.col("se"), F.col("ss") + F.when(inner, ignore).otherwise(0), F.col("se") - ignore, cfg.interleave),
        window("final_tail", F.col("last"), i + 1, i, F.col("se"), F.col("e"), F.col("se"), F.col("e"), cfg.tail_step),
    )
    return s.select("episode_index", "seg_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("episode_index", "seg_id", "x.*")


def sampling_blocks(segments: DataFrame, cfg, fps: Column | None = None) -> DataFrame:
    """(episode_index, seg_id, kind, target, memory, first_frame, step, n): the windows as arithmetic progressions, none empty."""
    w = sampling_windows(segments, cfg, fps)
    up = lambda x: F.ceil(x / F.col("step")).cast("long")
    w = w.withColumn("full", F.greatest(up(F.col("b") - F.col("a")), F.lit(0)))
    w = w.withColumn("f", F.least(F.greatest(up(F.col("lo") - F.col("a")), F.lit(0)), F.col("full")))
    w = w.withColumn("l", F.least(F.greatest(up(F.col("hi") - F.col("a")), F.col("f")), F.col("full")))
    return w.select("episode_index", "seg_id", "kind", "target", "memory", (F.col("a") + F.col("f") * F.col("step")).alias("first_frame"), "step", (F.col("l") - F.col("f")).alias("n")).filter("n > 0")


def expand_frames(blocks: DataFrame) -> DataFrame:
    """One row for each frame of each block."""
    last = F.col("first_frame") + (F.col("n") - 1) * F.col("step")
    frames = F.when(F.col("n") > 0, F.sequence("first_frame", last, "step"))
    return blocks.select("episode_index", "seg_id", "kind", "target", F.explode(frames).alias("frame"))


def block_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("kind").agg(F.sum("n").alias("frames"), F.count(F.lit(1)).alias("blocks"))


def resolve_targets(frames: DataFrame, windows: DataFrame, bucket: int = 4096) -> DataFrame:
    """Each frame's target: of the first window that holds it, by segment, then transition, uniform, final tail; else null. Long episodes are dealt out by buckets of frames."""
    order = F.when(F.col("kind") == "transition", 0).when(F.col("kind") == "uniform", 1).otherwise(2)
    w = windows.filter("hi > lo").select("episode_index", "seg_id", "kind", "target", F.col("lo").alias("start_frame"), F.col("hi").alias("end_frame"), order.alias("o"))
    held = interval_join(frames, w, how="left", bucket=bucket)
    return held.groupBy("episode_index", "frame_index").agg(F.min_by("target", F.struct("seg_id", "o")).alias("target"), F.min_by("kind", F.struct("seg_id", "o")).alias("kind"))


def random_window_samples(windows: DataFrame, seed: str) -> DataFrame:
    """One frame of each window, decided by a hash of seed, episode, segment and kind; an empty final tail gives its last frame."""
    from spanforge.functions.score import hash_seed

    key = F.concat_ws("|", F.lit(seed), "episode_index", "seg_id", "kind")
    size = F.col("b") - F.col("a")
    frame = F.when(size > 0, F.col("a") + F.pmod(hash_seed(key), F.greatest(size, F.lit(1)))).when(F.col("kind") == "final_tail", F.col("b") - 1)
    return windows.select("episode_index", "seg_id", "kind", "target", frame.alias("frame")).filter("frame is not null")


def contiguity(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """Violations: (episode_index, gaps, empty, uncovered), for episodes that have any."""
    before = F.lag("end_frame", 1, 0).over(of_episode())
    marked = segments.withColumn("gap", (F.col("start_frame") != before).cast("long")).withColumn("empty", (F.col("end_frame") <= F.col("start_frame")).cast("long"))
    one = marked.groupBy("episode_index").agg(F.sum("gap").alias("gaps"), F.sum("empty").alias("empty"), F.max("end_frame").alias("last"))
    found = episodes.select("episode_index", "length").join(one, "episode_index", "left")
    found = found.select("episode_index", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("empty", F.lit(0)).alias("empty"), (F.coalesce("last", F.lit(-1)) != F.col("length")).cast("long").alias("uncovered"))
    return found.filter("gaps + empty + uncovered > 0")


def chain_breaks(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_index, at): labels that can't be used: the first segment that doesn't begin where the one before ends, -1 if there is none at all, or the number of segments if the last doesn't end with the episode. Empty segments are let pass."""
    before = F.lag("end_frame", 1, 0).over(of_episode())
    place = F.row_number().over(of_episode()) - 1
    one = segments.withColumn("__p", place).withColumn("__bad", F.when(F.col("start_frame") != before, F.col("__p")))
    one = one.groupBy("episode_index").agg(F.min("__bad").alias("bad"), F.count(F.lit(1)).alias("n"), F.max_by("end_frame", "__p").alias("end"))
    found = episodes.select("episode_index", "length").join(one, "episode_index", "left")
    at = F.when(F.col("n").isNull(), -1).when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("end") != F.col("length"), F.col("n"))
    return found.select("episode_index", at.cast("long").alias("at")).filter("at is not null")


def reflow(segments: DataFrame) -> DataFrame:
    """Starts follow from the ends before; texts are trimmed, segments numbered anew; code names what is wrong with an end."""
    w = of_episode()
    start = F.lag("end_frame", 1, 0).over(w)
    code = F.when(F.col("end_frame") < 0, "negative").when(F.col("end_frame") <= start, "not_increasing").otherwise("ok")
    return segments.select("episode_index", (F.row_number().over(w) - 1).cast("long").alias("seg_id"), start.alias("start_frame"), "end_frame", F.trim("text").alias("text"), code.alias("code"))


def half_open(segments: DataFrame, length: Column) -> DataFrame:
    """Inclusive ends as exclusive ones, not past the episode's length."""
    return segments.withColumn("end_frame", F.least(F.col("end_frame") + 1, length))


def boundaries_to_segments(rows: DataFrame) -> DataFrame:
    """(episode_index, seg_id, start_frame, end_frame) from boundaries (array) and length."""
    starts, ends = F.concat(F.array(F.lit(0).cast("long")), "boundaries"), F.concat("boundaries", F.array("length"))
    return rows.select("episode_index", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("pos", "x")).select(
        "episode_index", F.col("pos").cast("long").alias("seg_id"), F.col("x.s").alias("start_frame"), F.col("x.e").alias("end_frame")
    )


def merge_prev(rows: DataFrame) -> DataFrame:
    """Segments kept, each to the end of those after it that merge into it; action is keep, merge_prev or drop. What merges before any is kept is dropped."""
    w = Window.partitionBy("episode_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    g = rows.withColumn("grp", F.sum((F.col("action") == "keep").cast("long")).over(w)).filter("grp > 0 and action <> 'drop'")
    return g.groupBy("episode_index", "grp").agg(F.min_by("start_frame", "pos").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count(F.lit(1)).alias("parts"))


def islands(rows: DataFrame, same: list[str]) -> DataFrame:
    """Neighbours with equal, non-null values in `same` become one: (episode_index, island, start_frame, end_frame, *same, parts)."""
    w = Window.partitionBy("episode_index").orderBy("start_frame", "end_frame", "pos")
    stays = F.lit(True)
    for c in same:
        stays = stays & F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False))
    g = rows.withColumn("new", F.when(stays, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return g.groupBy("episode_index", "island", *same).agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count(F.lit(1)).alias("parts"))


def rebuild_coverage(rows: DataFrame) -> DataFrame:
    """Inclusive ends so that segments cover 0 .. frames - 1 without gaps, each with a frame at least; further segments than frames are left out.

    The end that a cursor would set is i + min(T - n, max(0, largest e_j - j up to i)); the last is T - 1.
    """
    w = Window.partitionBy("episode_index").orderBy("pos")
    kept = rows.withColumn("i", F.row_number().over(w) - 1).filter("i < frames")
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    far = F.max(F.col("end_frame") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    end = F.when(F.col("i") == n - 1, F.col("frames") - 1).otherwise(F.col("i") + F.least(F.col("frames") - n, F.greatest(F.lit(0), far)))
    done = kept.select("episode_index", F.col("i").cast("long").alias("seg_id"), end.cast("long").alias("end_frame"))
    return done.withColumn("start_frame", F.lag("end_frame", 1, -1).over(of_episode()) + 1)


def split_segments(segments: DataFrame, at: DataFrame) -> DataFrame:
    """Cuts the segment that holds frame `at` (one row an episode) in two, with a frame left on either side where it has two."""
    s = segments.join(at, "episode_index", "left")
    hit = (F.col("at") >= F.col("start_frame")) & (F.col("at") < F.col("end_frame")) & (F.col("end_frame") - F.col("start_frame") >= 2)
    cut = F.least(F.greatest(F.col("at"), F.col("start_frame") + 1), F.col("end_frame") - 1)
    ends = F.when(hit, F.array(cut, "end_frame")).otherwise(F.array("end_frame"))
    out = s.select("episode_index", "seg_id", "text", F.posexplode(ends).alias("part", "end_frame"))
    w = Window.partitionBy("episode_index").orderBy("seg_id", "part")
    return out.select("episode_index", (F.row_number().over(w) - 1).cast("long").alias("seg_id"), F.lag("end_frame", 1, 0).over(w).alias("start_frame"), "end_frame", "text")


def delete_segments(segments: DataFrame, gone: Column) -> DataFrame:
    """Without the segments that `gone` holds for; the next takes their frames, before it the last one's go with it."""
    return reflow(segments.filter(~gone)).drop("code")


def move_boundaries(segments: DataFrame, delta: Column) -> DataFrame:
    """Each inner boundary moved by delta, but not past the segments beside it."""
    w = of_episode()
    after = F.lead("end_frame").over(w)
    moved = F.least(F.greatest(F.col("end_frame") + delta, F.col("start_frame") + 1), after - 1)
    s = segments.withColumn("moved", F.when(after.isNull() | (delta == 0), F.col("end_frame")).otherwise(moved))
    return s.select("episode_index", "seg_id", F.lag("moved", 1, 0).over(w).alias("start_frame"), F.col("moved").alias("end_frame"))


def mark_end(segments: DataFrame, at: DataFrame) -> DataFrame:
    """Adds a segment from an episode's last end to frame `at` (one row an episode, with length), if that lies after it and within the episode; an episode without segments gets its first."""
    ends = segments.groupBy("episode_index").agg(F.max("end_frame").alias("__end"), F.count(F.lit(1)).alias("__n"))
    new = at.join(ends, "episode_index", "left").select("episode_index", F.coalesce("__n", F.lit(0)).cast("long").alias("seg_id"), F.coalesce("__end", F.lit(0)).cast("long").alias("start_frame"), F.least("at", "length").alias("end_frame"), F.lit("").alias("text"))
    return segments.select("episode_index", "seg_id", "start_frame", "end_frame", "text").unionByName(new.filter("end_frame > start_frame"))


def finish_to_end(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds a segment from an episode's last end to its length, if that lies after it."""
    return mark_end(segments, episodes.select("episode_index", "length", F.col("length").alias("at")))


def nearest_boundary(segments: DataFrame, at: DataFrame) -> DataFrame:
    """(episode_index, seg_id): the segment whose end is the inner boundary nearest to frame `at` (one row an episode), the first of equally near ones; episodes without inner boundaries give no row."""
    inner = segments.withColumn("__more", F.lead("seg_id").over(of_episode()).isNotNull()).filter("__more")
    return inner.join(at.select("episode_index", "at"), "episode_index").groupBy("episode_index").agg(F.min_by("seg_id", F.struct(F.abs(F.col("end_frame") - F.col("at")), "seg_id")).alias("seg_id"))


def interval_join(frames: DataFrame, intervals: DataFrame, closed: bool = False, how: str = "inner", bucket: int | None = None) -> DataFrame:
    """Frames with the intervals of their episode that hold them. bucket: width of the frame buckets over which long episodes are dealt out."""
    i = intervals.withColumnRenamed("episode_index", "__e")
    inside = (F.col("frame_index") >= F.col("start_frame")) & ((F.col("frame_index") <= F.col("end_frame")) if closed else (F.col("frame_index") < F.col("end_frame")))
    on = (F.col("episode_index") == F.col("__e")) & inside
    if bucket:
        to = F.greatest(F.col("start_frame"), F.col("end_frame") - (0 if closed else 1))
        i = i.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_frame") / bucket), F.floor(to / bucket))))
        on = on & (F.floor(F.col("frame_index") / bucket) == F.col("__b"))
    return frames.join(i, on, how).drop("__e", *(["__b"] if bucket else []))
