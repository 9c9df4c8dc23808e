"""Episode tables in the shape of the engine's own, made from the test tables; and the same as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SamplingConfig:
    fps: float = 10.0
    interleave: int = 3
    dense_step: int = 2
    tail_step: int = 1
    ignore_sec: float = 0.1
    tail_sec: float = 0.3
    head_sec: float = 0.2
    last_sec: float = 0.3


CONFIG = SamplingConfig()
PHRASES = (
    "The robot arm opens the drawer.", "closes the sliding tray", "Gripper  picks up the RED cup.", "wait for the arm",
    "moves toward the table", "robot base navigates to the shelf..", "closing the pull-out shelf", "remains idle",
    "pulls open the drawer", "stay   idle near bin", "The manipulator places the plate", "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_index, frame_index, event_type, value, ts, k): each user's events in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_index"),
        (F.row_number().over(w) - 1).cast("long").alias("frame_index"),
        "event_type",
        "value",
        "ts",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_id",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_index, seg_id, start_frame, end_frame, text, skill): up to five contiguous segments an episode."""
    part = F.least(F.lit(4), F.floor((F.dayofmonth("ts") - 1) / 6)).cast("int")
    f = frames(spark, sf_dir).withColumn("part", part)
    n = f.groupBy("episode_index", "part", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"))
    s = n.groupBy("episode_index", "part").agg(
        F.min("lo").alias("start_frame"), (F.max("hi") + 1).alias("end_frame"), F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("text")
    )
    skill = F.create_map(*[F.lit(x) for kv in SKILLS.items() for x in kv])[F.col("text")]
    w = Window.partitionBy("episode_index").orderBy("part")
    return s.select("episode_index", (F.row_number().over(w) - 1).cast("long").alias("seg_id"), "start_frame", "end_frame", "text", skill.alias("skill"))


SKILLS = {"click": "Press", "view": "Scan", "purchase": "Pick", "signup": "Open", "error": "Release"}


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_index, length, task, action_config): segments nested in order."""
    s = segments(spark, sf_dir)
    longest = F.min_by("text", F.struct(-(F.col("end_frame") - F.col("start_frame")), F.col("seg_id")))
    one = F.struct("seg_id", "start_frame", "end_frame", "text", "skill")
    return s.groupBy("episode_index").agg(
        F.max("end_frame").alias("length"), longest.alias("task"), F.array_sort(F.collect_list(one)).alias("action_config")
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, phrase, skill, k): robot phrases dealt out over events."""
    f = frames(spark, sf_dir)
    listed = F.array(*[F.lit(p) for p in PHRASES])
    skill = F.element_at(F.array(*[F.lit(x) for x in ("Open", "Close", "Pick", "Move", "Pull")]), (F.pmod("k", F.lit(5)) + 1).cast("int"))
    return f.select("event_id", F.element_at(listed, (F.pmod(F.col("event_id"), F.lit(12)) + 1).cast("int")).alias("phrase"), skill.alias("skill"), "k", "value")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, task_text, sample_kind, subtask_score, memory_score, total_score, skipped): labels as judge's verdicts."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    kind = F.element_at(F.array(F.lit("subtask"), F.lit("transition"), F.lit("final_tail")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    j = l.join(d, "doc_id").select(
        "doc_id", F.col("lang").alias("task_text"), F.col("source").alias("dataset"), kind.alias("sample_kind"), (5.0 * F.col("quality")).alias("subtask_score"),
        (5.0 * (1 - F.col("toxic"))).alias("memory_score"), (F.pmod("doc_id", F.lit(11)) == 0).alias("skipped"),
    )
    return j.withColumn("total_score", F.col("subtask_score") + F.col("memory_score"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_index, sample_id, role, pred, skip): conversations as a session's predictions."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("episode_index"), F.col("turn").alias("sample_id"), "role", F.when(F.col("role") == "assistant", F.col("text")).alias("pred"), (F.col("role") == "system").alias("skip"))


_listed = ", ".join(f"'{p}'" for p in PHRASES)
#: The same views for DuckDB, to stand before a query.
SQL = f"""with f as (select user_id as episode_index, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_index,
    event_type, value, ts, cast(props->>'$.k' as bigint) as k, event_id from events),
fn as (select episode_index, least(4, (day(ts) - 1) // 6) as part, event_type, count(*) as n, min(frame_index) as lo, max(frame_index) as hi from f group by all),
s0 as (select episode_index, part, min(lo) as start_frame, max(hi) + 1 as end_frame, arg_min(event_type, (-n, event_type)) as text from fn group by all),
s as (select episode_index, row_number() over (partition by episode_index order by part) - 1 as seg_id, start_frame, end_frame, text,
    case text when 'click' then 'Press' when 'view' then 'Scan' when 'purchase' then 'Pick' when 'signup' then 'Open' else 'Release' end as skill from s0),
e as (select episode_index, max(end_frame) as length, arg_min(text, (-(end_frame - start_frame), seg_id)) as task from s group by all),
ph as (select event_id, [{_listed}][cast(event_id % 12 + 1 as int)] as phrase, ['Open', 'Close', 'Pick', 'Move', 'Pull'][cast(k % 5 + 1 as int)] as skill, k, value from f),
j as (select doc_id, lang as task_text, source as dataset, ['subtask', 'transition', 'final_tail'][cast(doc_id % 3 + 1 as int)] as sample_kind,
    5.0::double * quality as subtask_score, 5.0::double * (1 - toxic) as memory_score, doc_id % 11 = 0 as skipped,
    5.0::double * quality + 5.0::double * (1 - toxic) as total_score from labels join documents using (doc_id)),
st as (select conv_id as episode_index, turn as sample_id, role, case when role = 'assistant' then text end as pred, role = 'system' as skip from conversations)
"""
