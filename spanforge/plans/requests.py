"""Queries on requests, prompts, samples, models and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import requests as rq
from spanforge.functions import text as tx
from spanforge.operators import models as md
from spanforge.operators import samples as sp
from spanforge.operators.ordering import numbered
from spanforge.operators.rewrite import SKILLS, output_fps
from spanforge.plans.intervals import WINDOWS, _windows
from spanforge.plans.registry import query
from spanforge.sources import proxies as px


def pick(column, *values):
    """One of the values, by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


def scalar(name, sql, columns):
    """A query of columns on events, (name, column) each; sql gives the same."""
    query(name, f"select event_id, {sql} from f")(lambda spark, d: px.frames(spark, d).select("event_id", *[c.alias(n) for n, c in columns()]))


scalar("f_contains_any", "k % 3 = 1 as hit", lambda: [("hit", rq.contains_any(pick("k", "the cup", "  A RED   Drawer.", "none"), ["red drawer", "plate"]))])
scalar("f_exact_match", "k % 4 < 2 as same", lambda: [("same", tx.exact_match(pick("k", " a b", "a b\n", "a  b", "A b"), F.lit("a b ")))])
scalar("f_output_fps", "case k % 3 when 0 then '30' when 1 then '29.97' else '23.976' end as fps", lambda: [("fps", output_fps(pick("k", 30.0, 29.97, 23.9761)))])
scalar("f_session_names", "['my_run-episode-', 'eval-episode-', 'a.b-episode-'][cast(k % 3 + 1 as int)] || printf('%06d', event_id) as name, ['my_run_', 'default', '_a_b_'][cast(k % 3 + 1 as int)] as folder",
       lambda: [("name", rq.session_name(pick("k", "my run!", "", "_a.b."), F.col("event_id"))), ("folder", rq.session_folder(pick("k", "my run!", "", ".a.b.")))])
scalar("f_head_view", "case when k % 2 = 0 then 1 else 0 end as place", lambda: [("place", rq.head_view(F.when(F.pmod("k", F.lit(2)) == 0, F.array(F.lit("left"), F.lit(" HEAD "))).otherwise(F.array(F.lit("x.cam_high"), F.lit("head")))).cast("long"))])
scalar("f_main_video_key", "['b.head', 'front', 'x'][cast(k % 3 + 1 as int)] as main", lambda: [("main", rq.main_video_key(pick("k", "a, b.head,front", " front ,head", "x,,y")))])
scalar("f_ordered_plan", "['1. go, 2. take', 'go', '1. a, 2. b', '|'][cast(k % 4 + 1 as int)] as plan",
       lambda: [("plan", F.replace(rq.plan_text(rq.ordered_plan(pick("k", " go | take |", "go", "a\n\n b ", " | "))), F.lit("\n"), F.lit(", ")))])
scalar("f_ordered_list", "case when k % 2 = 0 then 'x,y' else 'd' end as items", lambda: [("items", F.array_join(rq.ordered_list(F.when(F.pmod("k", F.lit(2)) == 0, F.array(F.lit(" x"), F.lit(""), F.lit("y "))).otherwise(F.array(F.lit(" "))), F.array(F.lit("d"), F.lit(""))), ","))])
scalar("f_aliases", "case when k % 3 = 0 then 'websocket' else 'local' end as backend, case when k % 2 = 0 then 'per_dataset_equal' else 'global' end as mode, case when k % 3 = 1 then 'head_wrists' else 'head' end as view",
       lambda: [("backend", rq.alias_of(pick("k", " WS", "model", ""), rq.POLICY_BACKENDS, "local")), ("mode", rq.alias_of(pick("k", "dataset_equal", "Merged"), rq.SAMPLE_MODES, "global")), ("view", rq.alias_of(pick("k", "single", "head+wrists", ""), rq.VIEW_MODES, "head"))])
scalar("p_sample_kind", "['subtask', 'transition', 'final_tail', 'unknown'][cast(k % 4 + 1 as int)] as kind", lambda: [("kind", rq.sample_kind(pick("k", "uniform", "transition_dense", "final_tail_dense", "other")))])
_skills = ", ".join(SKILLS)
scalar("f_policy_header", f"""case when k % 2 = 0 then 'Global Task Goal: go' || chr(10) else '' end || case when k % 3 = 0 then 'Input Language Memory: m' || chr(10) else '' end || case when k % 5 = 0 then 'steps' || chr(10) else '' end || 'Candidate Atomic Skills: [{_skills}]' as plain,
    case when k % 2 = 0 then 'Global Task Goal: go' || chr(10) else '' end || case when k % 3 = 0 then 'Input Language Memory: m' || chr(10) else '' end || case when k % 5 <> 0 and (k % 2 = 1 or k % 7 <> 0) then 'Detailed Global Task Instruction: ' || case when k % 7 = 0 then 'go' else 'go there' end || chr(10) else '' end || 'Candidate Atomic Skills: [{_skills}]' as detailed""",
       lambda: [*[(n, rq.policy_header(pick("k", "go", ""), pick("k", "m", "", ""), pick("k", "steps", "", "", "", ""), pick("k", "go", *["go there"] * 6), SKILLS, u)) for n, u in (("plain", False), ("detailed", True))]])
scalar("f_policy_prompt", f"'H' || chr(10) || 'Image 1 (head view):' || chr(10) || 'Image 2 (' || event_type || '):' || chr(10) || '{rq.ANSWER_FORM}' as prompt", lambda: [("prompt", rq.policy_prompt(F.lit("H"), F.array(F.lit("head view"), F.col("event_type"))))])
scalar("f_judge_prompt", """'R[Question]' || chr(10) || 'Task Goal: t' || chr(10) || 'Input Language Memory: ' || chr(10) || chr(10) || '[Reference Answer]' || chr(10) || '{"current_subtask":"' || event_type || '","active_language_memory":"m"}' || chr(10) || chr(10) || '[Assistant Answer]' || chr(10) || k || chr(10) || chr(10) || 'Now output JSON only.' as prompt""",
       lambda: [("prompt", rq.judge_prompt("R", F.lit("t"), F.lit(None).cast("string"), F.col("event_type"), F.lit("m"), F.col("k").cast("string")))])
scalar("f_compare_prompt", """'be strict' || chr(10) || 'be brief' || chr(10) || chr(10) || '[Reference Subtask]' || chr(10) || event_type || chr(10) || chr(10) || '[Assistant Subtask]' || chr(10) || case when k % 2 = 0 then k::varchar else '' end || chr(10) || chr(10) || 'Now output JSON only.' as prompt""",
       lambda: [("prompt", rq.compare_prompt(["be strict", "be brief"], F.col("event_type"), F.when(F.pmod("k", F.lit(2)) == 0, F.col("k").cast("string"))))])
scalar("f_annotation_prompt", f"""'Input:' || chr(10) || '- sample_id: e' || event_id || chr(10) || '- total_frames: ' || (k + 1) || chr(10) || '- fps: 10.0' || chr(10) || '- allowed_atomic_skills: [{_skills}]' || chr(10)
    || case when k % 3 = 0 then '- task_instruction: tidy ' || event_type || chr(10) || '{rq.NOTES[0]}' || chr(10) else '' end || case when k % 2 = 0 then '{rq.NOTES[1]}' || chr(10) else '' end || 'Rules:' || chr(10) || '1. cover all' || chr(10) || '2. no gaps' || chr(10)
    || 'Answer with JSON alone, in this form:' || chr(10) || '{{"sample_id":"e' || event_id || '","nframes":' || (k + 1) || ',"fps":10.0,"task":"","segments":[{{"seg_id":0,"start_frame":0,"end_frame":' || k || ',"substask":"","primitive_skill":""}}]}}' as prompt""",
       lambda: [("prompt", rq.annotation_prompt(["cover all", "no gaps"], F.concat(F.lit("e"), F.col("event_id").cast("string")), F.col("k") + 1, F.lit(10.0), SKILLS, F.when(F.pmod("k", F.lit(3)) == 0, F.concat(F.lit(" tidy "), "event_type")).otherwise(" "), F.pmod("k", F.lit(2)) == 0))])
scalar("f_join_path", "['s3://b/x/e.mp4', '/abs/e', 'c:s3://b/e', '/d/e.mp4', '/f/e'][cast(k % 5 + 1 as int)] as path",
       lambda: [("path", rq.join_path(pick("k", "s3://b/x/", "/d", "/d", "/d/./x/", "/d"), pick("k", "./e.mp4", "/abs/e", "c:s3://b/e", "../e.mp4", "../../f//e")))])
scalar("f_portable_path", "['x/e.json', '/other/e', 'e'][cast(k % 3 + 1 as int)] as path", lambda: [("path", rq.portable_path(pick("k", "/root/x/./e.json", "/other/e", "/root/y/../e"), "/root"))])
scalar("f_time_labels", "['t', 't-0.5s', 't+1.3s'][cast(k % 3 + 1 as int)] as off, printf('%.1fs', k / 4.0) as at", lambda: [("off", rq.offset_label(pick("k", 0.0, -0.5, 1.25001))), ("at", rq.time_label(F.col("k") / 4.0))])
scalar("f_byte_range", """case k % 6 when 0 then 200 when 1 then 206 when 2 then 206 when 3 then 206 when 4 then 416 else 416 end as status, case k % 6 when 0 then 0 when 1 then k when 2 then 990 when 3 then 5 end as start,
    case k % 6 when 0 then 999 when 1 then 999 when 2 then 999 when 3 then 20 end as fin, case k % 6 when 0 then 1000 when 1 then 1000 - k when 2 then 10 when 3 then 16 end as length""",
       lambda: [*[(n, rq.byte_range(F.element_at(F.array(F.lit(""), F.concat(F.lit("bytes="), F.col("k").cast("string"), F.lit("-")), F.lit("bytes=-10"), F.lit(" bytes=5-20"), F.lit("bytes=1000-"), F.lit("bytes=-")), (F.pmod("k", F.lit(6)) + 1).cast("int")), F.lit(1000).cast("long"))[c]) for n, c in (("status", "status"), ("start", "start"), ("fin", "end"), ("length", "length"))]])
scalar("f_timeline", "cast(floor(frame_index / 200.0 * 640) as bigint) as pixel", lambda: [("pixel", rq.timeline(F.col("frame_index"), F.lit(200), 640))])
scalar("f_wrapped", "case k % 2 when 0 then 'note: aa bb' || chr(10) || '      cc' else 'note: <empty>' end as text", lambda: [("text", rq.wrapped("note", pick("k", "aa bb cc", "  "), 7))])
scalar("f_visual_fps", "case k % 4 when 0 then 12.0 when 1 then 4.0 when 2 then 10.0 else 1.0 end::double as fps", lambda: [("fps", rq.visual_fps(F.when(F.pmod("k", F.lit(4)) == 0, 12.0), pick("k", 0.0, 0.25, 0.0, 0.0), F.lit(30.0), pick("k", 1, 1, 3, 100)))])
scalar("f_request_task", "['a', 'b', 'c', 'd'][cast(k % 4 + 1 as int)] as task", lambda: [("task", rq.request_task(pick("k", " a", " ", "", ""), pick("k", "x", "b ", "", ""), F.when(F.pmod("k", F.lit(4)) == 2, F.array(F.lit(" c"))).otherwise(F.array().cast("array<string>")), F.lit("d")))])
scalar("f_chat_text", "case k % 5 when 0 then 'hi' || k when 1 then 'a' || chr(10) || 'b' when 2 then 'deep' end as text, case k % 5 when 3 then 'html' when 4 then 'no_content' end as error",
       lambda: [*[(c, rq.chat_text(F.element_at(F.array(F.concat(F.lit('{"choices":[{"message":{"content":"hi'), F.col("k").cast("string"), F.lit('"}}]}')), F.lit('{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}}]}'), F.lit('"{\\"choices\\":[{\\"message\\":{\\"content\\":\\"deep\\"}}]}"'), F.lit(" <!DOCTYPE html><p>"), F.lit('{"choices":[]}')), (F.pmod("k", F.lit(5)) + 1).cast("int")))[c]) for c in ("text", "error")]])
scalar("p_routed", """case when k % 5 in (0, 1) then 'ok' else 'error' end as status, ['ping', 'inference_result', 'unknown', 'inference_result', 'inference_result'][cast(k % 5 + 1 as int)] as type, case k % 5 when 0 then 'r' when 1 then 'p' || k else 'default' end as request_id,
    case k % 5 when 2 then 'Unsupported message type ''x''' when 3 then 'Payload must be a dict' when 4 then 'no_json' end as error, k % 5 = 1 as has""",
       lambda: [*[(c, rq.routed(F.element_at(F.array(F.lit('{"type": "ping", "request_id": "r"}'), F.concat(F.lit('{"payload": {"request_id": "p'), F.col("k").cast("string"), F.lit('"}}')), F.lit('{"type": "x"}'), F.lit('{"type": "infer", "payload": [1]}'), F.lit("{oops")), (F.pmod("k", F.lit(5)) + 1).cast("int")))[c]) for c in ("status", "type", "request_id", "error")],
       ("has", rq.routed(F.element_at(F.array(F.lit('{"type": "ping", "request_id": "r"}'), F.lit('{"payload": {"request_id": "p"}}'), F.lit('{"type": "x"}'), F.lit('{"type": "infer", "payload": [1]}'), F.lit("{oops")), (F.pmod("k", F.lit(5)) + 1).cast("int")))["payload"].isNotNull())])
scalar("f_to_json", """'{"type":"' || event_type || '","k":' || k || ',"sign":"é"}' as json""", lambda: [("json", F.to_json(F.struct(F.col("event_type").alias("type"), "k", F.lit("é").alias("sign"))))])


@query("p_find_episode", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 1", views=False)
def find_episode(spark, d):
    o = px.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("task_id"), F.col("o_custkey").alias("episode_index"), F.struct("o_orderdate", "o_orderkey").alias("pos"))
    return sp.find_episode(o, task="F").select("o_orderkey", "o_custkey")


@query("p_timestamp", "select event_id, case when k % 3 = 0 then k / 2.0::double else frame_index / 10.0::double end as timestamp from f")
def timestamp(spark, d):
    f = px.frames(spark, d).withColumn("timestamp", F.when(F.pmod("k", F.lit(3)) == 0, F.col("k") / 2.0))
    return sp.at_time(f, F.lit(10.0)).select("event_id", "timestamp")


#: Episodes with memories in some segments: `m` of a place, none in every fourth segment, texts blank in every fifth.
TALK = """, tk as (select s.*, case when (s.episode_index + seg_id) % 4 = 0 then null else 'm' || seg_id end as lm, case when (s.episode_index + seg_id) % 5 = 0 then '' else text end as at, count(*) over (partition by s.episode_index) as ns from s)
"""


def _talk(spark, d):
    config = F.transform("action_config", lambda x: F.struct(
        x["seg_id"].alias("seg_id"), F.when(F.pmod(F.col("episode_index") + x["seg_id"], F.lit(5)) == 0, "").otherwise(x["text"]).alias("action_text"), x["skill"].alias("skill"),
        F.when(F.pmod(F.col("episode_index") + x["seg_id"], F.lit(4)) == 0, None).otherwise(F.concat(F.lit("m"), x["seg_id"].cast("string"))).alias("language_memory"),
        F.lit(" ").alias("active_language_memory"), F.when(x["seg_id"] == 0, "u").alias("updated_language_memory")))
    return px.episodes(spark, d).withColumn("action_config", config)


_given = "coalesce(i.lm, case when i.seg_id = 0 then 'u' end)"
_active = "case when w.target = n.ns then 'The task ''' || e.task || ''' has been completed.' else g.lm end"
_text = "case when w.target = n.ns or g.at = '' then 'task_completed' else g.at end"


@query("p_samples_with_texts", WINDOWS + TALK + f""", n as (select distinct episode_index, ns from tk)
select w.episode_index, w.seg_id, w.kind, w.target, {_given} as input_language_memory, {_active} as gt_active_language_memory, {_text} as gt_current_subtask, case when w.target < n.ns and g.at <> '' then g.skill end as gt_current_skill,
    case when w.target = 0 then '' when p.at = '' then 'task_completed' else p.at end as previous_subtask, case when w.target = n.ns then '' when w.target = n.ns - 1 or x.at = '' then 'task_completed' else x.at end as next_subtask
from win w join e using (episode_index) join n using (episode_index) left join tk i on i.episode_index = w.episode_index and i.seg_id = w.memory left join tk g on g.episode_index = w.episode_index and g.seg_id = w.target
left join tk p on p.episode_index = w.episode_index and p.seg_id = w.target - 1 left join tk x on x.episode_index = w.episode_index and x.seg_id = w.target + 1
where {_given} is not null and {_active} is not null""")
def samples_with_texts(spark, d):
    s = sp.with_texts(_windows(spark, d).select("episode_index", "seg_id", "kind", "target", "memory"), _talk(spark, d))
    return s.drop("task")


@query("p_closed_loop", WINDOWS + TALK + f""", n as (select distinct episode_index, ns from tk), r as (select f.episode_index, frame_index, arg_min(target, (seg_id, case kind when 'transition' then 0 when 'uniform' then 1 else 2 end)) as target,
    arg_min(kind, (seg_id, case kind when 'transition' then 0 when 'uniform' then 1 else 2 end)) as kind from f join win on win.episode_index = f.episode_index and frame_index >= lo and frame_index < hi group by f.episode_index, frame_index)
select w.episode_index, frame_index, w.target, w.kind, 'said ' || frame_index as memory, {_text} as gt_current_subtask, {_active} as gt_active_language_memory from r w join e using (episode_index) join n using (episode_index)
left join tk g on g.episode_index = w.episode_index and g.seg_id = w.target where {_active} is not null""")
def closed_loop(spark, d):
    steps = px.frames(spark, d).select("episode_index", "frame_index", F.concat(F.lit(" said "), F.col("frame_index").cast("string")).alias("memory"))
    out = sp.closed_loop(steps, _windows(spark, d), _talk(spark, d))
    return out.select("episode_index", "frame_index", "target", "kind", "memory", "gt_current_subtask", "gt_active_language_memory")


@query("p_task_of_episode", """select c_custkey, case when c_custkey % 5 = 0 then 'listed' when c_custkey % 5 = 1 then 'plain' when c_custkey % 5 = 2 then 'told' when c_custkey % 5 = 3 then 'nation ' || n_nationkey else '' end as task
    from customer left join nation on n_nationkey = c_nationkey""", views=False)
def task_of_episode(spark, d):
    c, m = px.table(spark, d, "customer"), F.pmod("c_custkey", F.lit(5))
    e = c.select("c_custkey", F.when(m == 0, F.array(F.lit(" "), F.lit("listed | more"))).otherwise(F.array().cast("array<string>")).alias("tasks"), F.when(m == 1, "plain|x").alias("task_description"), F.when(m == 2, " told ").alias("language_instruction"),
                 F.when(m == 3, F.col("c_nationkey")).alias("task_index"))
    t = px.table(spark, d, "nation").select(F.col("n_nationkey").alias("task_index"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("task"))
    return sp.task_of_episode(e, t).select("c_custkey", "task")


@query("o_in_order", "select event_id, row_number() over (order by k, event_id) as place from f")
def in_order(spark, d):
    rows = px.frames(spark, d).select("event_id", "k")
    return numbered(rows, [F.col("k"), F.col("event_id")], "place").select("event_id", (F.col("place") + 1).alias("place"))


@query("o_first_per_key", "select episode_index, frame_index from f where frame_index < 7")
def first_per_key(spark, d):
    return sp.first_per_key(px.frames(spark, d).select("episode_index", "frame_index"), "episode_index", "frame_index", 7)


@query("a_total_records", "select max(o_custkey) as total_records, count(*) as records from orders", views=False)
def total_records(spark, d):
    o = px.table(spark, d, "orders").withColumn("shard", F.pmod("o_orderkey", F.lit(4)))
    return sp.total_records(o.groupBy("shard").agg(F.max("o_custkey").alias("total_records"), F.count(F.lit(1)).alias("records")))


@query("a_first_tasks", "select t as template, 'task ' || min(c_custkey) as task from (select c_custkey, c_nationkey % 4 as t from customer where c_custkey % 3 <> 0) group by t", views=False)
def first_tasks(spark, d):
    from spanforge.operators.segment import first_tasks

    c = px.table(spark, d, "customer")
    labels = c.select(F.col("c_custkey").alias("episode_index"), F.pmod("c_nationkey", F.lit(4)).alias("template"), F.when(F.pmod("c_custkey", F.lit(3)) != 0, F.array(F.concat(F.lit("task "), F.col("c_custkey").cast("string")))).otherwise(F.array().cast("array<string>")).alias("tasks"))
    return first_tasks(labels).select("template", F.col("tasks")[0].alias("task"))


@query("a_mean_confidence", "select episode_index, round_even(avg(k / 64.0::double), 4) as confidence from f group by episode_index")
def mean_confidence(spark, d):
    return px.frames(spark, d).groupBy("episode_index").agg(F.bround(F.avg(F.col("k") / 64.0), 4).alias("confidence"))


@query("o_candidate_frames", """, b as (select episode_index, length, 1 as boundary, length // 2 as expected from e where length > 3), m as (select f.episode_index, frame_index, value, lag(value) over w as p, lead(value) over w as n from f window w as (partition by f.episode_index order by frame_index)),
c as (select b.*, frame_index, value, row_number() over (partition by b.episode_index order by value, abs(frame_index - expected), frame_index) as r from m join b using (episode_index)
    where (frame_index % 3 = 0 and frame_index between greatest(1, expected - 6) and least(length - 1, expected + 6)) or frame_index = expected or (value <= p and value <= n and frame_index > greatest(1, expected - 6) and frame_index < least(length - 2, expected + 6)))
select distinct episode_index, boundary, least(greatest(frame_index, 1), length - 1) as frame_index from c where r <= 4 or frame_index = expected""")
def candidate_frames(spark, d):
    f = px.frames(spark, d)
    e = px.episodes(spark, d).filter("length > 3").select("episode_index", F.lit(1).alias("boundary"), F.floor(F.col("length") / 2).alias("expected"), F.lit(6).alias("reach"), "length")
    return sp.candidate_frames(f.filter("frame_index % 3 = 0"), f.select("episode_index", "frame_index", F.col("value").alias("motion")), e, 4)


@query("u_overlap_judge", "select event_id, case k % 5 when 0 then 1.0 when 1 then 0.9 when 2 then 0.4 else 0.0 end::double as subtask_score from f")
def overlap_judge(spark, d):
    f = px.frames(spark, d).select("event_id", F.lit("pick up the red cup").alias("reference"), pick("k", "Pick up the RED cup.", "pick up the cup red", "pick the green cup", "wait", "").alias("answer"))
    return md.judged(f, "reference", "answer").select("event_id", "subtask_score")


def _policy():
    return lambda rows: [{"answer": f"{r['event_type']}:{r['k']}"} if r["k"] % 7 else 1 / 0 for r in rows]


@query("u_predict", "select event_id, case when k % 7 <> 0 then event_type || ':' || k end as answer, case when k % 7 = 0 then 'division by zero' end as error from f")
def predict(spark, d):
    return md.predict(px.frames(spark, d).select("event_id", "event_type", "k"), _policy, "event_id long, answer string, error string", batch=1)


@query("u_rescored", """, q as (select event_id, (k % 10) / 10.0::double as score, 'pick the ' || event_type as said, case when k % 3 = 0 then 'pick the view' end as before, case when k % 4 = 0 then ' ' else 'Pick the error.' end as after, event_type from f)
select event_id, case when score < 0.5 then case when before is null then 0.0 when event_type = 'view' then 1.0 else 0.4 end::double end as before, case when score < 0.5 then case when trim(after) = '' then 0.0 when event_type = 'error' then 1.0 else 0.4 end::double end as after from q""")
def rescored(spark, d):
    m = lambda n: F.pmod("k", F.lit(n)) == 0
    f = px.frames(spark, d).select(
        "event_id", (F.pmod("k", F.lit(10)) / 10.0).alias("subtask_judge_score"), F.concat(F.lit("pick the "), "event_type").alias("pred_current_subtask"),
        F.when(m(3), "pick the view").alias("neighbor_previous_subtask"), F.when(m(4), " ").otherwise("Pick the error.").alias("neighbor_next_subtask"),
    )
    return md.rescored(f, 0.5).select("event_id", F.col("neighbor_prev_judge_score").alias("before"), F.col("neighbor_next_judge_score").alias("after"))
