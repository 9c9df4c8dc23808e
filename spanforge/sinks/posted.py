"""Annotations that are posted: checked, normalised, and put in place of what was saved before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import strip
from spanforge.operators.rewrite import normalize_saved
from spanforge.operators.tables import latest_by, upsert
from spanforge.sinks.writers import exists, kept, swap

# Fixed value: most bytes of a request.
MOST = 10 * 1024 * 1024
BODY = "task_text string, action_config array<struct<end_frame:string,action_text:string,skill:string>>"
SEGMENT = "array<struct<seg_id:long,start_frame:long,end_frame:long,action_text:string,skill:string>>"
SAVED = f"episode_index long, length long, task_text string, action_config {SEGMENT}"


def checked(posts: DataFrame, most: int = MOST) -> DataFrame:
    """posts with `error`: what is wrong with a request, and `text`, its body, where nothing is. posts: (header, body, ...), header: the length that was announced, body: bytes."""
    length = F.try_to_number(F.trim("header"), F.lit("999999999999"))
    text = F.try_validate_utf8(F.col("body").cast("binary")) if hasattr(F, "try_validate_utf8") else F.col("body").cast("string")
    kind = F.schema_of_variant(F.try_parse_json(text))
    error = (
        F.when(F.coalesce(F.trim("header"), F.lit("")) == "", "missing body").when(length.isNull(), "invalid length").when(length <= 0, "missing body").when(length > most, "too long")
        .when(text.isNull() | kind.isNull(), "no JSON").when(~F.startswith(kind, F.lit("OBJECT")), "no object")
    )
    return posts.withColumn("error", error).withColumn("text", F.when(error.isNull(), text))


def save(posts: DataFrame, episodes: DataFrame, path: str, most: int = MOST) -> DataFrame:
    """Saves each episode's last good post in the annotations kept as JSON under path, whole or not at all; (number, episode_index, error) of all posts.

    posts: (number, episode_index, header, body); episodes: (episode_index, length). A post is good if the request is and its segments, each from the end of the one before,
    run to the episode's end; otherwise its first error is told and what was saved before stays. Posts for episodes that there aren't are `no episode`.
    """
    spark = posts.sparkSession
    asked = checked(posts, most).join(episodes.select("episode_index", F.col("length").alias("__l")), "episode_index", "left")
    asked = kept(asked.withColumn("error", F.coalesce("error", F.when(F.col("__l").isNull(), "no episode"))).withColumn("r", F.from_json("text", BODY)).drop("body", "text", "header"), "posts")
    good = asked.filter("error is null")
    rows = good.select(F.col("number").alias("episode_index"), F.posexplode("r.action_config").alias("seg_id", "x"))
    rows = rows.select("episode_index", "seg_id", F.expr("try_cast(x.end_frame as bigint)").alias("end_frame"), F.coalesce("x.action_text", F.lit("")).alias("text"), F.coalesce("x.skill", F.lit("")).alias("skill"))
    segments, wrong = normalize_saved(rows, good.select(F.col("number").alias("episode_index"), F.col("__l").alias("length")))
    issue = wrong.groupBy("episode_index").agg(F.min_by("code", F.coalesce("seg_id", F.lit(1 << 40))).alias("code")).withColumnRenamed("episode_index", "number")
    told = kept(asked.join(issue, "number", "left").withColumn("error", F.coalesce("error", "code")).drop("code"), "told")
    last = latest_by(told.filter("error is null").select("number", "episode_index", "__l", F.coalesce(strip(F.col("r.task_text")), F.lit("")).alias("task_text")), ["episode_index"], ["number"])
    config = segments.groupBy(F.col("episode_index").alias("number")).agg(F.array_sort(F.collect_list(F.struct("seg_id", "start_frame", "end_frame", F.col("text").alias("action_text"), "skill"))).alias("action_config"))
    docs = last.join(config, "number").select("episode_index", F.col("__l").alias("length"), "task_text", "action_config")
    if exists(spark, path):
        docs = upsert(spark.read.schema(SAVED).json(path), docs, ["episode_index"])
    docs.write.mode("overwrite").json(path + ".new")
    swap(spark, path + ".new", path)
    return told.select("number", "episode_index", "error")
