"""Roll-ups of judged predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.score import RELATIONS, safe_ratio




def kind_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, sums and exact matches of the rows that were not skipped."""
    live = rows.filter("not skipped")
    return live.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("subtask_score").alias("subtask_sum"),
        F.sum("memory_score").alias("memory_sum"),
        F.sum("total_score").alias("total_sum"),
        F.count_if(F.col("subtask_score") >= 5).alias("exact_subtask"),
        F.count_if(F.col("memory_score") >= 5).alias("exact_memory"),
    )


def step_summary(rows: DataFrame) -> DataFrame:
    """One row: all rows, skipped ones, and averages over the others."""
    live = ~F.col("skipped")
    n = F.count_if(live)
    avg = lambda c: F.round(safe_ratio(F.sum(F.when(live, F.col(c))), n), 6)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("skipped").alias("skipped"), n.alias("evaluated"), avg("subtask_score").alias("subtask_avg"),
        avg("memory_score").alias("memory_avg"), avg("total_score").alias("total_avg"),
        F.round(safe_ratio(F.count_if(live & (F.col("subtask_score") >= 5) & (F.col("memory_score") >= 5)), n), 6).alias("exact_ratio"),
    )


def source_histogram(rows: DataFrame, source: str) -> DataFrame:
    """(source, n): how many rows name each source; null and blank ones are `<missing>`."""
    name = F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("<missing>"))
    return rows.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def neighbor_failures(rows: DataFrame, threshold: float) -> DataFrame:
    """For each kind and for all (kind null): rows analysed, failed, and failures by relation, zeros included."""
    failed = F.col("subtask_score") < threshold
    by = [F.count_if(failed & (F.col("relation") == r)).alias(r) for r in RELATIONS]
    return rows.filter("not skipped").rollup("sample_kind").agg(F.count(F.lit(1)).alias("analyzed"), F.count_if(failed).alias("failed"), *by)


def episode_summary(rows: DataFrame) -> DataFrame:
    """For each episode: its samples in order, the first and last memory, and averages over judged rows."""
    ids = F.transform(F.array_sort(F.collect_list("sample_id")), lambda x: x.cast("string"))
    return rows.groupBy("episode_index").agg(
        F.count(F.lit(1)).alias("samples"), F.array_join(ids, ",").alias("sample_ids"), F.min_by("memory_in", "sample_id").alias("first_memory"),
        F.max_by("memory_out", "sample_id").alias("last_memory"), F.count("score").alias("judged"), F.round(F.avg("score"), 6).alias("score_avg"),
    )


def task_rollup(rows: DataFrame) -> DataFrame:
    """For each task and for all (task null): episodes, samples and the average weighted by samples; null without samples overall."""
    task = F.coalesce(F.nullif(F.trim("task_text"), F.lit("")), F.lit("<empty_task>"))
    r = rows.withColumn("task", task).rollup("task").agg(F.count(F.lit(1)).alias("episodes"), F.sum("samples").alias("samples"), F.sum("score_sum").alias("s"))
    avg = F.when(F.col("task").isNull() & (F.col("samples") == 0), None).otherwise(F.col("s") / F.greatest("samples", F.lit(1)))
    return r.select("task", "episodes", "samples", F.round(avg, 6).alias("score_avg"))
