"""Evaluation samples: which episode, which target, which texts; sorting and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as tx

# Keys of an episode's detailed task, in order.
DETAILED = ("detailed_task_instruction", "detailed_global_task_instruction", "global_task_instruction", "task_instruction")


def find_episode(episodes: DataFrame, task: str | None = None, episode: int | None = None, order: str = "pos") -> DataFrame:
    """The first episode of this task and number, of any where one is None; no row if there is none."""
    kept = episodes
    if task is not None:
        kept = kept.filter(F.col("task_id").cast("string") == task)
    if episode is not None:
        kept = kept.filter(F.col("episode_index") == episode)
    return kept.orderBy(order).limit(1)


def at_time(frames: DataFrame, fps: Column) -> DataFrame:
    """frames with timestamp; where there is no such column, or no value, from frame_index and fps."""
    own = F.col("timestamp") if "timestamp" in frames.columns else F.lit(None).cast("double")
    return frames.withColumn("timestamp", F.coalesce(own.cast("double"), F.col("frame_index") / fps))


def input_memory(segment: Column) -> Column:
    """A segment's first memory that isn't blank; null without a segment."""
    return F.coalesce(*[F.nullif(tx.strip(segment[k]), F.lit("")) for k in ("language_memory", "active_language_memory", "updated_language_memory")])


def subtask_at(config: Column, at: Column) -> tuple[Column, Column]:
    """(text, skill) of a place in an episode; (task_completed, null) outside it or where the text is blank."""
    seg = F.get(config, at.cast("int"))
    text = F.when((at >= 0) & (at < F.size(config)), F.nullif(tx.strip(seg["action_text"]), F.lit("")))
    return F.coalesce(text, F.lit("task_completed")), F.when(text.isNotNull(), F.nullif(tx.strip(seg["skill"]), F.lit("")))


def neighbor_text(config: Column, at: Column) -> Column:
    """The text beside a target: empty before the first and past the end, task_completed at the end."""
    return F.when((at < 0) | (at > F.size(config)), "").when(at == F.size(config), "task_completed").otherwise(subtask_at(config, at)[0])


def with_texts(samples: DataFrame, episodes: DataFrame) -> DataFrame:
    """samples (episode_index, target, memory, ...) with task, input and active memory, subtask and skill, without those that lack a memory.

    episodes: (episode_index, task, action_config with action_text, skill, and memories).
    """
    s = samples.withColumnRenamed("memory", "__m").join(episodes.select("episode_index", "task", "action_config"), "episode_index")
    config, at = F.col("action_config"), F.col("target")
    text, skill = subtask_at(config, at)
    active = tx.active_memory(F.get(config, at.cast("int"))["language_memory"], at, F.size(config), F.col("task"))
    given = F.when((F.col("__m") >= 0) & (F.col("__m") < F.size(config)), input_memory(F.get(config, F.col("__m").cast("int"))))
    out = s.withColumns({"input_language_memory": given, "gt_active_language_memory": active, "gt_current_subtask": text, "gt_current_skill": skill})
    out = out.withColumns({"previous_subtask": neighbor_text(config, at - 1), "next_subtask": neighbor_text(config, at + 1)})
    return out.filter("input_language_memory is not null and gt_active_language_memory is not null").drop("action_config", "__m")


def closed_loop(steps: DataFrame, windows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Steps (episode_index, frame_index, memory) as samples: target and kind by the windows, texts by the episode; steps without a target or a text are left out."""
    from spanforge.operators.intervals import resolve_targets

    found = resolve_targets(steps.select("episode_index", "frame_index").distinct(), windows).filter("target is not null")
    s = steps.join(found, ["episode_index", "frame_index"]).join(episodes.select("episode_index", "task", "action_config"), "episode_index")
    config, at = F.col("action_config"), F.col("target")
    text, skill = subtask_at(config, at)
    active = tx.active_memory(F.get(config, at.cast("int"))["language_memory"], at, F.size(config), F.col("task"))
    out = s.withColumns({"gt_current_subtask": text, "gt_current_skill": skill, "gt_active_language_memory": active, "memory": tx.strip(F.col("memory"))})
    return out.filter("gt_current_subtask <> '' and gt_active_language_memory is not null").drop("action_config")


def task_of_episode(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """episodes with `task`: its first task, else task, task_description or language_instruction, else that of its task_index; up to the first bar. "" if there is none."""
    names = tasks.select(F.col("task_index").alias("__i"), F.col("task").alias("__t"))
    e = episodes.join(names, F.col("task_index") == F.col("__i"), "left")
    listed = F.get(F.filter(F.transform("tasks", tx.strip), lambda x: x != ""), F.lit(0))
    some = [F.nullif(tx.strip(c), F.lit("")) for c in (listed, *[F.col(c) for c in ("task", "task_description", "language_instruction") if c in episodes.columns], F.col("__t"))]
    return e.withColumn("task", tx.task_text(F.coalesce(*some, F.lit("")))).drop("__i", "__t")


def in_order(records: DataFrame, *keys: str, drop: str | None = None) -> DataFrame:
    """Records in order, without the column that only gave the order."""
    out = records.orderBy(*keys)
    return out.drop(drop) if drop else out


def first_per_key(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key; all for 0."""
    if most <= 0:
        return rows
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("__r") <= most).drop("__r")


def total_records(shards: DataFrame, count: str = "total_records") -> DataFrame:
    """One row: what the shards say there is in all (the largest), and how many records they hold."""
    return shards.agg(F.max(count).alias("total_records"), F.sum("records").alias("records"))


def candidate_frames(samples: DataFrame, motion: DataFrame, expected: DataFrame, keep: int = 45) -> DataFrame:
    """(episode_index, boundary, frame_index): of the sampled frames and minima of motion within reach of an expected boundary, the `keep` of least motion, and the expected one.

    expected: (episode_index, boundary, expected, reach, length). Equal motion is settled by nearness, then by the earlier frame.
    """
    w = Window.partitionBy("episode_index").orderBy("frame_index")
    low = (F.col("motion") <= F.lag("motion").over(w)) & (F.col("motion") <= F.lead("motion").over(w))
    m = motion.select("episode_index", "frame_index", "motion", F.coalesce(low, F.lit(False)).alias("low"))
    m = m.join(samples.select("episode_index", "frame_index", F.lit(True).alias("sampled")), ["episode_index", "frame_index"], "left")
    e = expected.withColumns({"lo": F.greatest(F.lit(1), F.col("expected") - F.col("reach")), "hi": F.least(F.col("length") - 1, F.col("expected") + F.col("reach"))})
    f, inside = F.col("frame_index"), lambda a, b: F.col("frame_index").between(a, b)
    pool = m.join(e, "episode_index").filter(
        (F.col("sampled") & inside(F.col("lo"), F.col("hi"))) | (f == F.col("expected")) | (F.col("low") & (f > F.greatest(F.lit(1), F.col("lo"))) & (f < F.least(F.col("length") - 2, F.col("hi"))))
    )
    best = Window.partitionBy("episode_index", "boundary").orderBy("motion", F.abs(f - F.col("expected")), f)
    kept = pool.withColumn("__r", F.row_number().over(best)).filter((F.col("__r") <= keep) | (f == F.col("expected")))
    at = F.greatest(F.lit(1), F.least(F.col("length") - 1, f))
    always = expected.select("episode_index", "boundary", F.greatest(F.lit(1), F.least(F.col("length") - 1, F.col("expected"))).alias("frame_index"))
    return kept.select("episode_index", "boundary", at.alias("frame_index")).unionByName(always).distinct()
