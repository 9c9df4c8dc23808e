"""From a model's answer about an episode to a document of contiguous segments.

Raw segments: (episode_index, pos, seg_id, start_frame, end_frame, text, skill, frames), ends inclusive, pos the place in
the answer, frames the episode's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.functions.jsonx import outer_braces

# The skills that a segment may have, and the fields that an answer and its segments need.
SKILLS = ("Pick", "Place", "Plug", "Press", "Push", "Pull", "Move", "Fold", "Wipe", "Close", "Open", "Pour", "Cut", "Screw", "Handover", "Sweep")
ANSWER_FIELDS = ("sample_id", "nframes", "fps", "task", "segments")
SEGMENT_FIELDS = ("seg_id", "start_frame", "end_frame", "substask", "primitive_skill")
INTEGERS = ("seg_id", "start_frame", "end_frame")


def _segment_texts(json: Column) -> Column:
    return F.from_json(F.get_json_object(json, "$.segments"), "array<string>")


def response_issue(response: Column, frames: Column) -> Column:
    """What is wrong with an answer, the first thing found; null if nothing is.

    no_json, missing_<field>, bad_length, no_segments, segment_<i>_missing_<field>, segment_<i>_not_integer.
    """
    json = outer_braces(response)
    keys = F.json_object_keys(json)
    top = [F.when(~F.array_contains(keys, f), F.lit(f"missing_{f}")) for f in ANSWER_FIELDS]

    def of_segment(x: Column, i: Column) -> Column:
        name = lambda what: F.concat(F.lit("segment_"), i.cast("string"), F.lit("_" + what))
        has = F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))
        kind = F.coalesce(F.schema_of_variant(F.try_parse_json(x)), F.lit(""))
        missing = [F.when(~F.array_contains(has, f), name(f"missing_{f}")) for f in SEGMENT_FIELDS]
        whole = [F.when(~F.regexp_like(kind, F.lit(rf"\b{f}: BIGINT")), name("not_integer")) for f in INTEGERS]
        return F.coalesce(*missing, *whole)

    segments = _segment_texts(json)
    first = F.get(F.filter(F.transform(segments, of_segment), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(
        F.when(keys.isNull() | F.try_parse_json(json).isNull(), "no_json"),
        *top,
        F.when(F.coalesce(frames, F.lit(0)) <= 0, "bad_length"),
        F.when(segments.isNull() | (F.size(segments) == 0), "no_segments"),
        first,
    )


def parse_responses(rows: DataFrame, response: str = "response", frames: str = "frames") -> tuple[DataFrame, DataFrame]:
    """(raw segments of the answers that are right, (episode_index, issue) of the others)."""
    judged = rows.withColumn("issue", response_issue(F.col(response), F.col(frames)))
    seg = F.posexplode(_segment_texts(outer_braces(F.col(response)))).alias("pos", "seg")
    good = judged.filter("issue is null").select("episode_index", F.col(frames).cast("long").alias("frames"), seg)
    number = lambda f: F.get_json_object("seg", f"$.{f}").cast("long")
    raw = good.select(
        "episode_index", F.col("pos").cast("long").alias("pos"), number("seg_id").alias("seg_id"), number("start_frame").alias("start_frame"), number("end_frame").alias("end_frame"),
        F.coalesce(F.get_json_object("seg", "$.substask"), F.lit("")).alias("text"), F.coalesce(F.get_json_object("seg", "$.primitive_skill"), F.lit("")).alias("skill"), "frames",
    )
    return raw, judged.filter("issue is not null").select("episode_index", "issue")


def clamp(raw: DataFrame) -> DataFrame:
    """Starts from 0 on, ends within the episode and not before their starts."""
    start = F.greatest(F.lit(0), F.col("start_frame"))
    end = F.greatest(start, F.least(F.col("frames") - 1, F.col("end_frame")))
    return raw.withColumns({"start_frame": start, "end_frame": end})


def segment_action(skill: Column, text: Column) -> Column:
    """keep, merge_prev or drop: unknown skills and moves of the arm alone go or join what is before; so do idle and preparing steps."""
    aux = F.coalesce(tx.auxiliary_class(text), F.lit(""))
    aside = F.when(aux == "merge_prev", "merge_prev").otherwise("drop")
    no_move = (skill == "Move") & ~tx.base_move(text)
    return F.when(~skill.isin(*SKILLS) | no_move | (aux != ""), aside).otherwise("keep")


def classify(raw: DataFrame) -> DataFrame:
    """Clamped segments with plain texts, drawers pulled and pushed, and an action."""
    plain = clamp(raw).withColumns({"text": tx.subtask_text(F.col("text")), "skill": tx.strip(F.col("skill"))})
    skill, text = tx.drawer_rewrite(F.col("skill"), F.col("text"))
    plain = plain.withColumn("__s", skill).withColumn("text", text).withColumn("skill", F.col("__s")).drop("__s")
    return plain.withColumn("action", segment_action(F.col("skill"), F.col("text")))


def merge_auxiliary(rows: DataFrame) -> DataFrame:
    """The segments kept, each up to the end of those that join it; check_frame is its own end. What joins before any is kept goes."""
    w = Window.partitionBy("episode_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    g = rows.withColumn("__g", F.sum((F.col("action") == "keep").cast("long")).over(w)).filter("__g > 0 and action <> 'drop'")
    own = F.struct("pos", "seg_id", "start_frame", F.col("end_frame").alias("check_frame"), "text", "skill", "frames")
    one = g.groupBy("episode_index", "__g").agg(F.min_by(own, "pos").alias("own"), F.max("end_frame").alias("end_frame")).select("episode_index", "own.*", "end_frame")
    return one.withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.concat("skill", F.lit(" action"))))


def merge_drawers(rows: DataFrame) -> DataFrame:
    """Neighbours, by start, end and seg_id, that pull or push the same kind of drawer become one.

    It ends where the last of them does, its check frame is the latest, and its text the last one after the first that itself
    begins with pull or push, else the first one's.
    """
    kind = F.when(F.col("skill").isin("Pull", "Push"), tx.drawer_type(F.col("text")))
    w = Window.partitionBy("episode_index").orderBy("start_frame", "end_frame", "seg_id", "pos")
    r = rows.withColumn("__kind", kind).withColumn("__at", F.row_number().over(w))
    same = F.coalesce((F.col("__kind") == F.lag("__kind").over(w)) & (F.col("skill") == F.lag("skill").over(w)), F.lit(False))
    r = r.withColumn("__new", (~same).cast("long")).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    says = F.when((F.col("__new") == 0) & F.startswith(F.lower("text"), F.lower("skill")), F.col("text"))
    return r.groupBy("episode_index", "__island").agg(
        F.min("__at").alias("pos"), F.min_by("start_frame", "__at").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.max("check_frame").alias("check_frame"),
        F.coalesce(F.max_by(says, F.when(says.isNotNull(), F.col("__at"))), F.min_by("text", "__at")).alias("text"), F.first("skill").alias("skill"), F.max("frames").alias("frames"),
    ).drop("__island")


def cover(rows: DataFrame) -> DataFrame:
    """(episode_index, seg_id, start_frame, end_frame, check_frame, text, skill, frames): contiguous inclusive ranges over all frames.

    See `intervals.rebuild_coverage`; check frames are moved into their segments.
    """
    from spanforge.operators.intervals import rebuild_coverage

    whole = rebuild_coverage(rows.select("episode_index", "pos", "end_frame", "frames"))
    order = Window.partitionBy("episode_index").orderBy("pos")
    named = rows.withColumn("seg_id", (F.row_number().over(order) - 1).cast("long")).select("episode_index", "seg_id", F.col("check_frame").alias("__c"), "text", "skill", "frames")
    out = whole.join(named, ["episode_index", "seg_id"])
    check = F.least(F.greatest("__c", "start_frame"), F.col("end_frame"))
    return out.select("episode_index", "seg_id", "start_frame", "end_frame", check.alias("check_frame"), "text", "skill", "frames")


def rewrite_annotation(raw: DataFrame) -> DataFrame:
    """All of it: clamp, classify, merge, cover. Episodes of which no segment is kept give no rows."""
    return cover(merge_drawers(merge_auxiliary(classify(raw))))


def output_fps(fps: Column) -> Column:
    """As a text: whole rates without a fraction, others with three digits at most."""
    return F.when(fps == F.floor(fps), F.floor(fps).cast("string")).otherwise(F.round(fps, 3).cast("string"))


def annotation_documents(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_index, length, fps, tasks, action_config) from covered segments, ends made exclusive.

    episodes: (sample_id, episode_index, length, fps, task). Tasks and texts are sentences; a blank task gives no tasks.
    """
    end = F.least(F.col("end_frame") + 1, F.col("length"))
    rows = segments.join(episodes.select("episode_index", "length", "fps", "task"), "episode_index")
    one = F.struct("seg_id", "start_frame", end.alias("end_frame"), tx.sentence_case(F.col("text")).alias("action_text"), tx.strip(F.col("skill")).alias("skill"))
    task = tx.sentence_case(F.first("task"))
    return rows.groupBy("episode_index").agg(
        F.first("length").alias("length"), F.first("fps").alias("fps"), F.when(task == "", F.array().cast("array<string>")).otherwise(F.array(task)).alias("tasks"),
        F.array_sort(F.collect_list(one)).alias("action_config"),
    )


def check_frames(segments: DataFrame, directory: str) -> DataFrame:
    """The manifest of check frames: one image for each segment whose check frame isn't negative."""
    name = F.format_string("%s/seg_%03d_check_%06d.jpg", F.lit(directory), "seg_id", "check_frame")
    return segments.filter("check_frame >= 0").select("episode_index", "seg_id", "start_frame", "end_frame", F.col("check_frame").alias("frame_id"), F.col("skill").alias("primitive_skill"), tx.subtask_text(F.col("text")).alias("substask"), name.alias("image_path"))


def clips(frames: DataFrame, segments: DataFrame, directory: str, bucket: int = 4096) -> DataFrame:
    """The manifest of clips: the frames that each segment holds, end included, and where its clip goes."""
    from spanforge.operators.intervals import interval_join

    s = segments.select("episode_index", "seg_id", "start_frame", "end_frame", "skill", "text")
    held = interval_join(frames.select("episode_index", "frame_index"), s, closed=True, bucket=bucket)
    name = F.concat(F.format_string("%s/seg_%03d_", F.lit(directory), "seg_id"), tx.slug(F.col("text")), F.lit(".mp4"))
    keys = ["episode_index", "seg_id", "start_frame", "end_frame", "skill", "text"]
    return held.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame")).withColumn("clip_path", name)


def normalize_saved(segments: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments with starts from the ends before, texts trimmed, numbered anew; (episode_index, seg_id, code) of what is wrong).

    Codes: no_number, negative, not_increasing, past_end, and for an episode (seg_id null) empty and not_covered.
    Only the first of an episode's segments that is wrong counts; segments of episodes with a code are left out. An episode
    of unknown length (null or 0) may end anywhere.
    """
    w = Window.partitionBy("episode_index").orderBy("seg_id")
    s = segments.select("episode_index", (F.row_number().over(w) - 1).cast("long").alias("seg_id"), F.lag("end_frame", 1, 0).over(w).alias("start_frame"), "end_frame", tx.strip(F.col("text")).alias("text"), tx.strip(F.col("skill")).alias("skill"))
    s = s.join(episodes.select("episode_index", "length"), "episode_index")
    code = (
        F.when(F.col("end_frame").isNull(), "no_number")
        .when(F.col("end_frame") < 0, "negative")
        .when(F.col("end_frame") <= F.col("start_frame"), "not_increasing")
        .when((F.col("length") > 0) & (F.col("end_frame") > F.col("length")), "past_end")
    )
    s = s.withColumn("code", code)
    first = s.filter("code is not null").groupBy("episode_index").agg(F.min_by(F.struct("seg_id", "code"), "seg_id").alias("x")).select("episode_index", "x.*")
    ends = episodes.filter("length > 0").select("episode_index", "length").join(s.groupBy("episode_index").agg(F.max_by("end_frame", "seg_id").alias("end")), "episode_index", "left")
    short = ends.join(first, "episode_index", "left_anti").filter(F.col("end").isNull() | (F.col("end") != F.col("length")))
    short = short.select("episode_index", F.lit(None).cast("long").alias("seg_id"), F.when(F.col("end").isNull(), "empty").otherwise("not_covered").alias("code"))
    wrong = first.unionByName(short)
    good = s.join(wrong.select("episode_index").distinct(), "episode_index", "left_anti").select("episode_index", "seg_id", "start_frame", "end_frame", "text", "skill")
    return good, wrong
