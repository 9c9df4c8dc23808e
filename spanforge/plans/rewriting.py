"""Queries on rewriting a model's annotation into contiguous segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import rewrite as rw
from spanforge.plans.registry import query
from spanforge.plans.texts import _has
from spanforge.sources import proxies as px

#: Raw segments: an event each, with spans that overlap, leave gaps and pass the end; every fourth episode is short.
RAW = """, raw as (select f.episode_index, frame_index as pos, frame_index as seg_id, frame_index * 4 + f.k % 7 - 3 as start_frame, frame_index * 4 + f.k % 7 - 4 + f.k % 9 as end_frame, phrase, ph.skill as skill0,
    case when f.episode_index % 4 = 0 then 9 else 4 * count(*) over (partition by f.episode_index) end as frames from f join ph using (event_id))
"""


def _raw(spark, d):
    from pyspark.sql import Window

    f = px.frames(spark, d).join(px.phrases(spark, d).select("event_id", "phrase", "skill"), "event_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    start = F.col("frame_index") * 4 + F.pmod("k", F.lit(7)) - 3
    return f.select(
        "episode_index", F.col("frame_index").alias("pos"), F.col("frame_index").alias("seg_id"), start.alias("start_frame"), (start - 1 + F.pmod("k", F.lit(9))).alias("end_frame"),
        F.col("phrase").alias("text"), "skill", F.when(F.pmod("episode_index", F.lit(4)) == 0, 9).otherwise(n * 4).cast("long").alias("frames"),
    )


_plain = r"regexp_replace(rtrim(regexp_replace(trim(phrase), '\s+', ' ', 'g'), '.'), '(?i)" + tx.SUBJECT + "', '')"
_like = "case " + " ".join(f"when {_has('lower(t0)', keys, 'contains')} then '{kind}'" for kind, keys in tx.DRAWER.items()) + " end"
_kind = _like.replace("lower(t0)", "lower(text)")
_skills = ", ".join(f"'{x}'" for x in rw.SKILLS)
#: The same by SQL, with a closed form of the cursor that covers an episode.
CLASSIFIED = RAW + rf""", p as (select *, lower(left({_plain}, 1)) || substr({_plain}, 2) as t0 from raw),
p1 as (select *, {_like} is not null as dr from p),
p2 as (select episode_index, pos, seg_id, frames, greatest(0, start_frame) as start_frame, greatest(greatest(0, start_frame), least(frames - 1, end_frame)) as end_frame,
    case when dr and skill0 = 'Open' then 'Pull' when dr and skill0 = 'Close' then 'Push' else skill0 end as skill,
    case when dr and skill0 = 'Open' then regexp_replace(t0, '(?i)^(?:open|opens|opening)\s+', 'pulls open ')
        when dr and skill0 = 'Close' and regexp_matches(t0, '(?i)^(?:close|closes|closing)\s+') then 'pushes ' || trim(regexp_replace(t0, '(?i)^(?:close|closes|closing)\s+', '')) || ' closed' else t0 end as text from p1),
p3 as (select *, case when trim(text) = '' then '' when {_has("trim(lower(text))", tx.MERGE_PREV, "starts_with")} or contains(' ' || trim(lower(text)) || ' ', ' idle ') then 'merge_prev'
    when {_has("trim(lower(text))", tx.MERGE_NEXT, "starts_with")} then 'merge_next' else '' end as aux from p2),
cl as (select *, case when skill not in ({_skills}) or (skill = 'Move' and not ({_has('lower(text)', tx.BASE_MOVE, 'contains')})) or aux <> '' then case when aux = 'merge_prev' then 'merge_prev' else 'drop' end else 'keep' end as action from p3)
"""
MERGED = CLASSIFIED + """, g as (select *, sum((action = 'keep')::int) over (partition by episode_index order by pos) as g from cl),
mg as (select episode_index, arg_min(pos, pos) as pos, arg_min(seg_id, pos) as seg_id, arg_min(start_frame, pos) as start_frame, max(end_frame) as end_frame, arg_min(end_frame, pos) as check_frame,
    coalesce(nullif(arg_min(text, pos), ''), arg_min(skill, pos) || ' action') as text, arg_min(skill, pos) as skill, max(frames) as frames from g where g > 0 and action <> 'drop' group by episode_index, g)
"""
REWRITTEN = MERGED + f""", d0 as (select *, case when skill in ('Pull', 'Push') then {_kind} end as kind, row_number() over w as nr from mg window w as (partition by episode_index order by start_frame, end_frame, seg_id, pos)),
d1 as (select *, coalesce(kind = lag(kind) over w and skill = lag(skill) over w, false) as same from d0 window w as (partition by episode_index order by nr)),
d2 as (select *, sum((not same)::int) over (partition by episode_index order by nr) as island from d1),
d3 as (select episode_index, island, min(nr) as nr, max(end_frame) as end_frame, max(check_frame) as check_frame, max(frames) as frames, arg_min(skill, nr) as skill,
    coalesce(arg_max(text, nr) filter (where same and starts_with(lower(text), lower(skill))), arg_min(text, nr)) as text from d2 group by episode_index, island),
d4 as (select *, row_number() over (partition by episode_index order by nr) - 1 as i from d3), d5 as (select * from d4 where i < frames),
d6 as (select *, count(*) over (partition by episode_index) as n, max(end_frame - i) over (partition by episode_index order by i) as far from d5),
d7 as (select *, case when i = n - 1 then frames - 1 else i + least(frames - n, greatest(0, far)) end as fin from d6),
rw as (select episode_index, i as seg_id, coalesce(lag(fin) over (partition by episode_index order by i), -1) + 1 as start_frame, fin as end_frame, check_frame as c0, text, skill, frames from d7),
rew as (select episode_index, seg_id, start_frame, end_frame, least(greatest(c0, start_frame), end_frame) as check_frame, text, skill, frames from rw)
"""


@query("i_classify_segments", CLASSIFIED + "select episode_index, pos, start_frame, end_frame, text, skill, action from cl")
def classify(spark, d):
    return rw.classify(_raw(spark, d)).select("episode_index", "pos", "start_frame", "end_frame", "text", "skill", "action")


@query("i_merge_auxiliary", MERGED + "select episode_index, pos, start_frame, end_frame, check_frame, text, skill from mg")
def merge_auxiliary(spark, d):
    return rw.merge_auxiliary(rw.classify(_raw(spark, d))).select("episode_index", "pos", "start_frame", "end_frame", "check_frame", "text", "skill")


@query("i_rewrite_annotation", REWRITTEN + "select * from rew")
def rewrite(spark, d):
    return rw.rewrite_annotation(_raw(spark, d))


_sentence = "upper(left({0}, 1)) || substr({0}, 2) || case when right({0}, 1) in ('.', '!', '?') then '' else '.' end"


@query("k_annotation_document", REWRITTEN + f"""select episode_index, max(frames) as length, 'Episode ' || episode_index || '.' as task, string_agg(seg_id || ':' || start_frame || '-' || least(end_frame + 1, frames) || ' ' || skill || ' ' || {_sentence.format('text')}, '|' order by seg_id) as config
    from rew group by episode_index""")
def document(spark, d):
    seg = rw.rewrite_annotation(_raw(spark, d))
    e = _raw(spark, d).groupBy("episode_index").agg(F.max("frames").alias("length")).withColumns({"fps": F.lit(30.0), "task": F.concat(F.lit(" episode "), F.col("episode_index").cast("string"))})
    docs = rw.annotation_documents(seg, e)
    text = F.transform("action_config", lambda x: F.concat(x["seg_id"].cast("string"), F.lit(":"), x["start_frame"].cast("string"), F.lit("-"), x["end_frame"].cast("string"), F.lit(" "), x["skill"], F.lit(" "), x["action_text"]))
    return docs.select("episode_index", "length", F.element_at("tasks", 1).alias("task"), F.array_join(text, "|").alias("config"))


@query("k_check_frames", REWRITTEN + r"select episode_index, seg_id, start_frame, end_frame, check_frame as frame_id, skill as primitive_skill, printf('out/seg_%03d_check_%06d.jpg', seg_id, check_frame) as image_path from rew")
def check_frames(spark, d):
    return rw.check_frames(rw.rewrite_annotation(_raw(spark, d)), "out").drop("substask")


@query("k_clips", REWRITTEN + r""", fr as (select episode_index, unnest(range(0, 4 * n)) as frame_index from (select episode_index, count(*) as n from f group by all))
select r.episode_index, seg_id, start_frame, end_frame, skill, text, count(*) as frames, min(frame_index) as first_frame, max(frame_index) as last_frame,
    printf('clips/seg_%03d_', seg_id) || coalesce(nullif(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), 120), ''), 'subtask') || '.mp4' as clip_path
from rew r join fr on r.episode_index = fr.episode_index and frame_index between start_frame and end_frame group by all""")
def clips(spark, d):
    n = px.frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    frames = n.select("episode_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") * 4 - 1)).alias("frame_index"))
    return rw.clips(frames, rw.rewrite_annotation(_raw(spark, d)), "clips", bucket=64)


#: Segments with ends spoilt in some episodes: null, negative, not after their start, past the end, short of it.
SAVED = """, sv as (select s.episode_index, seg_id, case when s.episode_index % 9 = 1 and seg_id = 1 then null when s.episode_index % 9 = 2 and seg_id = 0 then -4 when s.episode_index % 9 = 3 and seg_id = 1 then start_frame
    when s.episode_index % 9 = 4 and end_frame = length then end_frame + 2 when s.episode_index % 9 = 5 and end_frame = length then end_frame - 1 else end_frame end as end_frame, '  ' || text || ' ' as text, skill, length from s join e using (episode_index)),
n0 as (select episode_index, seg_id, coalesce(lag(end_frame, 1, 0) over w, null) as start_frame, end_frame, trim(text) as text, skill, length from sv window w as (partition by episode_index order by seg_id)),
n1 as (select *, case when end_frame is null then 'no_number' when end_frame < 0 then 'negative' when end_frame <= start_frame then 'not_increasing' when end_frame > length then 'past_end' end as code from n0),
w1 as (select episode_index, arg_min(seg_id, seg_id) as seg_id, arg_min(code, seg_id) as code from n1 where code is not null group by episode_index),
w2 as (select episode_index, arg_max(end_frame, seg_id) as fin, max(length) as length from n1 where episode_index not in (select episode_index from w1) group by episode_index),
wr as (select * from w1 union all select episode_index, null, 'not_covered' from w2 where fin <> length)
"""


def _saved(spark, d):
    e = px.episodes(spark, d).select("episode_index", "length")
    m, end = F.pmod("episode_index", F.lit(9)), F.col("end_frame")
    spoilt = (
        F.when((m == 1) & (F.col("seg_id") == 1), None).when((m == 2) & (F.col("seg_id") == 0), -4).when((m == 3) & (F.col("seg_id") == 1), F.col("start_frame"))
        .when((m == 4) & (end == F.col("length")), end + 2).when((m == 5) & (end == F.col("length")), end - 1).otherwise(end)
    )
    s = px.segments(spark, d).join(e, "episode_index").select("episode_index", "seg_id", spoilt.alias("end_frame"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"), "skill")
    return rw.normalize_saved(s, e)


@query("v_normalize_saved", SAVED + "select episode_index, seg_id, start_frame, end_frame, text, skill from n1 where episode_index not in (select episode_index from wr)")
def normalize_saved(spark, d):
    return _saved(spark, d)[0]


@query("v_saved_issues", SAVED + "select * from wr")
def saved_issues(spark, d):
    return _saved(spark, d)[1]


#: Answers of which some lack a field, some have a text for a frame, some no JSON at all.
RESPONSES = """, rs as (select event_id as episode_index, k, case k % 8 when 0 then 'sorry' when 1 then 'x {"sample_id": 1, "nframes": 9, "fps": 30, "segments": []} y' else
    'Here: {"sample_id": "e", "nframes": 9, "fps": 30, "task": "t", "segments": [' || case k % 8 when 2 then '' when 3 then '{"seg_id": 0, "start_frame": 1, "end_frame": 2, "substask": "a"}'
    when 4 then '{"seg_id": 0, "start_frame": 1, "end_frame": "2", "substask": "a", "primitive_skill": "Pick"}' else '{"seg_id": 4, "start_frame": ' || k || ', "end_frame": 70, "substask": "' || event_type || '", "primitive_skill": "Pick"}' end || ']} done' end as response, event_type,
    case when k % 8 = 5 then 0 else 50 end as frames from f)
"""


def _responses(spark, d):
    f, m = px.frames(spark, d), F.pmod("k", F.lit(8))
    seg = F.concat(F.lit('{"seg_id": 4, "start_frame": '), F.col("k").cast("string"), F.lit(', "end_frame": 70, "substask": "'), "event_type", F.lit('", "primitive_skill": "Pick"}'))
    one = F.when(m == 2, "").when(m == 3, '{"seg_id": 0, "start_frame": 1, "end_frame": 2, "substask": "a"}').when(m == 4, '{"seg_id": 0, "start_frame": 1, "end_frame": "2", "substask": "a", "primitive_skill": "Pick"}').otherwise(seg)
    text = F.when(m == 0, "sorry").when(m == 1, 'x {"sample_id": 1, "nframes": 9, "fps": 30, "segments": []} y')
    text = text.otherwise(F.concat(F.lit('Here: {"sample_id": "e", "nframes": 9, "fps": 30, "task": "t", "segments": ['), one, F.lit("]} done")))
    return rw.parse_responses(f.select(F.col("event_id").alias("episode_index"), text.alias("response"), F.when(m == 5, 0).otherwise(50).alias("frames")))


@query("v_response_issues", RESPONSES + """select episode_index, case k % 8 when 0 then 'no_json' when 1 then 'missing_task' when 2 then 'no_segments' when 3 then 'segment_0_missing_primitive_skill' when 4 then 'segment_0_not_integer' when 5 then 'bad_length' end as issue from rs where k % 8 < 6""")
def response_issues(spark, d):
    return _responses(spark, d)[1]


@query("s_parse_responses", RESPONSES + """select episode_index, 0 as pos, cast(response[instr(response, '{'):-6]->'$.segments'->0->>'$.seg_id' as bigint) as seg_id, cast(response[instr(response, '{'):-6]->'$.segments'->0->>'$.start_frame' as bigint) as start_frame, cast(70 as bigint) as end_frame,
    response[instr(response, '{'):-6]->'$.segments'->0->>'$.substask' as text, 'Pick' as skill, 50 as frames from rs where k % 8 >= 6""")
def parsed(spark, d):
    return _responses(spark, d)[0]
