"""Queries on texts, JSON and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import arrays as ar
from spanforge.functions import jsonx as jx
from spanforge.functions import score as sc
from spanforge.functions import text as tx
from spanforge.operators.samples import subtask_at
from spanforge.plans.registry import query
from spanforge.sources import proxies as px

#: Turns of conversations with what a model's answers carry around them.
NOISY = """, no as (select conv_id, turn, '  ' || text || chr(10) || '  Current observation images (head view): ' || left(text, 20) || ' image 2 (left wrist):  tail,;' as t from conversations)
"""


def noisy(spark, d):
    t = F.concat(F.lit("  "), F.col("text"), F.lit("\n  Current observation images (head view): "), F.left("text", F.lit(20)), F.lit(" image 2 (left wrist):  tail,;"))
    return px.table(spark, d, "conversations").select("conv_id", "turn", t.alias("t"))


def turns(name, sql, f):
    query(name, NOISY + f"select conv_id, turn, {sql} as out from no")(lambda spark, d: noisy(spark, d).select("conv_id", "turn", f(F.col("t")).alias("out")))


_trim = r"regexp_replace(t, '^\s+|\s+$', '', 'g')"
_squeeze = rf"regexp_replace({_trim}, '\s+', ' ', 'g')"
turns("f_normalize_text", rf"regexp_replace(regexp_replace(lower(t), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')", tx.normalize)
turns("f_clean_memory", r"""trim(regexp_replace(regexp_replace(t, '(?i)\bcurrent\s+observation\s+images?(?:\s*\([^)]*\))?\s*[:：]?\s*|\bimage\s*\d+\s*\([^)]*\)\s*[:：]?\s*', ' ', 'g'), '\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || ',;:-')""", tx.clean_memory)
turns("f_truncate_memory", rf"""regexp_replace(rtrim(regexp_replace({_trim}, '(?is)[,;:\-\s]*(?:current\s+observation\s+images?(?:\s*\([^)]*\))?\s*[:：]?|image\s*\d+\s*\([^)]*\)\s*[:：]?)(?s:.*)$', ''), ' ' || chr(9) || chr(10) || ',;:-'), '^\s+|\s+$', '', 'g')""", tx.truncate_memory)
turns("f_sentence_case", rf"""case when right({_trim}, 1) in ('.', '!', '?') then upper(left({_trim}, 1)) || substr({_trim}, 2) else upper(left({_trim}, 1)) || substr({_trim}, 2) || '.' end""", tx.sentence_case)
turns("f_task_text", r"regexp_replace(split_part(t, '|', 1), '^\s+|\s+$', '', 'g')", tx.task_text)
turns("f_task_from_name", "array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z]+'), lambda x: lower(x)), ' ')", tx.task_from_name)


def phrased(name, sql, f, more=""):
    query(name, more + f"select event_id, {sql} from ph")(lambda spark, d: px.phrases(spark, d).select("event_id", *f(F.col("phrase"))))


_sub = r"regexp_replace(rtrim(regexp_replace(trim(phrase), '\s+', ' ', 'g'), '.'), '(?i)" + tx.SUBJECT + "', '')"
_low = rf"lower(left({_sub}, 1)) || substr({_sub}, 2)"


def _has(column, words, test):
    return " or ".join(f"{test}({column}, '{w}')" for w in words)


_aux = f"""case when trim(phrase) = '' then null when {_has("trim(lower(phrase))", tx.MERGE_PREV, "starts_with")} or contains(' ' || trim(lower(phrase)) || ' ', ' idle ') then 'merge_prev'
    when {_has("trim(lower(phrase))", tx.MERGE_NEXT, "starts_with")} then 'merge_next' end"""
_drawer = "case " + " ".join(f"when {_has('lower(phrase)', keys, 'contains')} then '{kind}'" for kind, keys in tx.DRAWER.items()) + " end"
phrased("f_subtask_text", f"{_low} as out", lambda c: [tx.subtask_text(c).alias("out")])
phrased("f_base_move", f"{_has('lower(phrase)', tx.BASE_MOVE, 'contains')} as out", lambda c: [tx.base_move(c).alias("out")])
phrased("f_aux_class", f"{_aux} as out", lambda c: [tx.auxiliary_class(c).alias("out")])
phrased("f_drawer_type", f"{_drawer} as out", lambda c: [tx.drawer_type(c).alias("out")])
phrased("f_slug", rf"coalesce(nullif(left(trim(regexp_replace(lower({_low}), '[^a-z0-9]+', '_', 'g'), '_'), 120), ''), 'subtask') as out", lambda c: [tx.slug(c).alias("out")])
_close = r"'(?i)^(?:close|closes|closing)\s+'"
phrased(
    "f_drawer_rewrite",
    rf"""case when {_drawer} is not null and skill = 'Open' then 'Pull' when {_drawer} is not null and skill = 'Close' then 'Push' else skill end as skill_out,
    case when {_drawer} is not null and skill = 'Open' then regexp_replace(phrase, '(?i)^(?:open|opens|opening)\s+', 'pulls open ')
    when {_drawer} is not null and skill = 'Close' and regexp_matches(phrase, {_close}) then 'pushes ' || trim(regexp_replace(phrase, {_close}, '')) || ' closed' else phrase end as out""",
    lambda c: [x.alias(n) for x, n in zip(tx.drawer_rewrite(F.col("skill"), c), ("skill_out", "out"), strict=True)],
)
phrased("f_subtask_list", """'Subtasks:' || chr(10) || array_to_string(list_filter([case when trim(phrase) <> '' then '1. ' || trim(phrase) else '' end, '2. ' || skill, case when k % 2 = 0 then '3. last' else '' end], lambda x: x <> ''), chr(10)) as out""",
        lambda c: [ar.numbered_list(F.array(c, F.col("skill"), F.when(F.pmod("k", F.lit(2)) == 0, "last").otherwise(""))).alias("out")])
phrased("f_coalesce_source", "coalesce(nullif(trim(phrase), ''), case when k % 3 = 0 then null else skill end, 'none') as text, case when trim(phrase) <> '' then 'detailed' when k % 3 <> 0 then 'task' else 'default' end as source",
        lambda c: [x.alias(n) for x, n in zip(tx.first_source(detailed=c, task=F.when(F.pmod("k", F.lit(3)) != 0, F.col("skill")), default=F.lit("none")), ("text", "source"), strict=True)])
phrased("p_skip_predicate", "contains(lower(phrase), 'content safety system') or contains(lower(phrase), 'content_policy_violation') as plain, k % 4 = 0 as made", lambda c: [tx.is_policy_violation(c).alias("plain"), tx.is_policy_violation(F.when(F.pmod("k", F.lit(4)) == 0, F.concat(c, F.lit(" Content_Policy_Violation!"))).otherwise(c)).alias("made")])
phrased("f_view_label", """case k % 7 when 0 then 'head view' when 1 then 'front view' when 2 then 'left wrist view' when 3 then 'right wrist view' when 4 then 'wrist view' when 5 then 'top cam view' else case when k % 2 = 0 then 'current view' else 'camera view 3' end end as out""",
        lambda c: [tx.view_label(F.get(F.array(*[F.lit(x) for x in ("observation.images.HEAD", "front_cam", "left_hand", "cam.right_wrist", "arm", "observation.top_cam", " ")]), F.pmod("k", F.lit(7)).cast("int")), F.lit(2), F.when(F.pmod("k", F.lit(2)) == 0, 1).otherwise(3)).alias("out")])


@query("f_active_memory", """select e.episode_index, i.i as id, case when i.i > ns then null when i.i = ns then 'The task ''' || task || ''' has been completed.' else (select text from s where s.episode_index = e.episode_index and s.seg_id = i.i) end as memory,
    case when i.i < ns then (select text from s where s.episode_index = e.episode_index and s.seg_id = i.i) else 'task_completed' end as subtask from e join (select episode_index, count(*) as ns from s group by all) using (episode_index), (select unnest(range(0, 7)) as i) i""")
def active_memory(spark, d):
    return _lookups(spark, d)


@query("f_subtask_lookup", """select e.episode_index, i.i as id, s.text, coalesce(nullif(case when s.text = 'view' then '' else s.text end, ''), 'task_completed') as subtask, case when s.text <> 'view' then s.skill end as skill from e cross join (select unnest(range(0, 7)) as i) i left join s on s.episode_index = e.episode_index and s.seg_id = i.i""")
def subtask_lookup(spark, d):
    e = px.episodes(spark, d).withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    blank = F.transform("action_config", lambda x: F.struct(F.when(x["text"] == "view", " ").otherwise(x["text"]).alias("action_text"), x["skill"].alias("skill")))
    text, skill = subtask_at(blank, F.col("id"))
    return e.select("episode_index", "id", F.get("action_config", F.col("id").cast("int"))["text"].alias("text"), text.alias("subtask"), skill.alias("skill"))


def _lookups(spark, d):
    e = px.episodes(spark, d).withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    at = F.get("action_config", F.col("id").cast("int"))["text"]
    n = F.size("action_config")
    return e.select("episode_index", "id", tx.active_memory(at, F.col("id"), n, F.col("task")).alias("memory"), F.coalesce(at, F.lit("task_completed")).alias("subtask"))


@query("f_html_guard", r"select page_id, regexp_matches(html, '(?is)^\s*<(!doctype html|html)') as html from pages", views=False)
def html_guard(spark, d):
    return px.table(spark, d, "pages").select("page_id", tx.is_html(F.col("html")).alias("html"))


@query("f_parse_index", "select event_id, case event_id % 4 when 0 then event_id when 1 then k when 2 then k else null end as out from f")
def parse_index(spark, d):
    made = F.element_at(F.array(F.concat(F.lit("x/episode_"), F.col("event_id")), F.concat(F.lit("episode-"), F.col("k"), F.lit(".mp4")), F.col("k").cast("string"), F.lit("none")), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    return px.frames(spark, d).select("event_id", tx.parse_index(made).alias("out"))


@query("f_sampling_rate", "select event_id, case when k % 2 = 0 then k / 100.0::double else 1.0 end as rate from f")
def rate(spark, d):
    name = F.when(F.pmod("k", F.lit(2)) == 0, F.concat(F.lit("set%"), F.col("k"))).otherwise(F.concat(F.lit("set"), F.col("k")))
    return px.frames(spark, d).select("event_id", tx.sampling_rate(name).alias("rate"))


@query("f_inline_config", "select event_id, 'set' || k as name, 'p/' || event_type as path, k % 5 as step from f")
def inline_config(spark, d):
    text = F.concat(F.lit("dataset_name=set"), F.col("k"), F.lit(" ; annotation_path=p/"), F.col("event_type"), F.lit(";step="), F.pmod("k", F.lit(5)))
    m = jx.inline_config(text)
    return px.frames(spark, d).select("event_id", m["dataset_name"].alias("name"), m["annotation_path"].alias("path"), m["step"].cast("long").alias("step"))


@query("f_checkpoint_seed", "select event_id, case when k % 3 = 0 then -1 else k end as step, case when k % 3 = 0 then 42 else 42 + k end as seed, case when k % 3 = 0 then 42 else 42 end as plain from f")
def checkpoint_seed(spark, d):
    path = F.when(F.pmod("k", F.lit(3)) == 0, "run/final").otherwise(F.concat(F.lit("run/checkpoint-"), F.col("k").cast("string")))
    return px.frames(spark, d).select("event_id", tx.checkpoint_step(path).alias("step"), tx.sampling_seed(42, path).alias("seed"), tx.sampling_seed(42, path, False).alias("plain"))


@query("f_video_paths", "select event_id, v.key as key, 'root/videos/' || v.key || '/' || event_id || '.mp4' as path from f, (values ('cam.head'), ('cam.left')) v(key)")
def video_paths(spark, d):
    f = px.frames(spark, d).withColumn("key", F.explode(F.array(F.lit("cam.head"), F.lit("cam.left"))))
    template = F.concat(F.lit("videos/{video_key}/"), F.col("event_id").cast("string"), F.lit(".mp4"))
    return f.select("event_id", "key", tx.video_path(F.lit("root"), template, F.col("key")).alias("path"))


@query("f_pad_keys", "select event_id, array_to_string([case when k % 4 >= 1 then 'a' else 'camera_0' end, case when k % 4 >= 2 then 'b' else 'camera_1' end, case when k % 4 >= 3 then 'c' else 'camera_2' end][1 : cast(k % 3 + 1 as int)], ',') as keys from f")
def pad_keys(spark, d):
    keys = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.pmod("k", F.lit(4)).cast("int"))
    return px.frames(spark, d).select("event_id", F.array_join(ar.pad_keys(keys, (F.pmod("k", F.lit(3)) + 1).cast("int")), ",").alias("keys"))


@query("f_masked_filter", "select event_id, case when k % 2 = 1 and k % 3 = 0 then 'x,y' when k % 2 = 1 then 'x' when k % 3 = 0 then 'y' else 'x,y' end as kept from f")
def masked(spark, d):
    kept = ar.masked(F.array(F.lit("x"), F.lit("y")), F.array(F.pmod("k", F.lit(2)) == 1, F.pmod("k", F.lit(3)) == 0))
    return px.frames(spark, d).select("event_id", F.array_join(kept, ",").alias("kept"))


@query("f_pad_mask", "select event_id, array_to_string(list_concat(range(0, k % 4), [9 for i in range(0, 3 - k % 4)])[1:3], ',') as items, k % 4 as n from f")
def pad_mask(spark, d):
    items = F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), F.pmod("k", F.lit(4)).cast("int"))
    padded, mask = ar.pad_mask(items, 3, F.lit(9))
    return px.frames(spark, d).select("event_id", F.array_join(F.transform(padded, lambda x: x.cast("string")), ",").alias("items"), F.size(F.filter(mask, lambda x: x)).cast("long").alias("n"))


@query("f_scale_index", """select event_id, k % 20 as i, cast(case when 7 + event_id % 3 <= 1 then 0 when 7 + event_id % 3 = 20 then k % 20 else least(greatest(round_even((k % (7 + event_id % 3)) * 19.0::double / (6 + event_id % 3), 0), 0), 19) end as bigint) as out from f""")
def scale_index(spark, d):
    n = F.lit(7) + F.pmod("event_id", F.lit(3))
    return px.frames(spark, d).select("event_id", F.pmod("k", F.lit(20)).alias("i"), sc.scale_index(F.pmod("k", n), n, F.lit(20)).alias("out"))


#: Answers of a judge: JSON of an event wrapped in talk.
ANSWERS = """, an as (select event_id, k, value, 'Sure: {"current_subtask": "' || event_type || ' {x}", "k": ' || k || '} subtask_score: ' || k % 6 || ' memory_score = ' || k % 4 || '.5 Verdict: Partial reason: "ok"' as t from f)
"""


def answers(spark, d):
    t = F.concat(F.lit('Sure: {"current_subtask": "'), F.col("event_type"), F.lit(' {x}", "k": '), F.col("k"), F.lit("} subtask_score: "), F.pmod("k", F.lit(6)), F.lit(" memory_score = "), F.pmod("k", F.lit(4)), F.lit('.5 Verdict: Partial reason: "ok"'))
    return px.frames(spark, d).select("event_id", "k", "event_type", t.alias("t"))


@query("f_outer_braces", ANSWERS + "select event_id, substr(t, instr(t, '{'), length(t) - instr(reverse(t), '}') + 2 - instr(t, '{')) as out from an")
def outer(spark, d):
    return answers(spark, d).select("event_id", jx.outer_braces(F.col("t")).alias("out"))


@query("f_judge_fallback", "select event_id, cast(k % 6 as double) as subtask_score, k % 4 + 0.5::double as memory_score, cast(null as double) as total_score, 'partial' as verdict, 'ok' as reason from f")
def fallback(spark, d):
    found = jx.judge_fields(F.col("t"))
    return answers(spark, d).select("event_id", *[c.alias(n) for n, c in found.items()])


@query("f_current_subtask", "select event_id, event_type || ' {x}' as out from f")
def current(spark, d):
    return answers(spark, d).select("event_id", jx.current_subtask(F.col("t")).alias("out"))


@query("f_extract_json", """select event_id, '{"current_subtask": "' || event_type || ' {x}", "k": ' || k || '}' as out from f""")
def extract(spark, d):
    return answers(spark, d).select("event_id", jx.extract_json(F.col("t")).alias("out"))


@query("f_judge_normalize", """, q as (select doc_id, 5.0::double * (subtask_score / 5) / case when doc_id % 2 = 0 then 5 else 1 end as a, memory_score / case when doc_id % 2 = 0 then 5 else 1 end as b from j),
q1 as (select doc_id, case when a between 0 and 1 and b between 0 and 1 then a * 5 else a end as s, case when a between 0 and 1 and b between 0 and 1 then b * 5 else b end as m from q),
q2 as (select *, case when s + m between 0 and 2 then (s + m) * 5 else s + m end as t0 from q1), q3 as (select *, case when t0 <= 0 then s + m else t0 end as t from q2)
select doc_id, s as subtask_score, m as memory_score, t as total_score, case when t >= 9 then 'correct' when t >= 5 then 'partial' else 'wrong' end as verdict from q3""")
def normalize(spark, d):
    by = F.when(F.pmod("doc_id", F.lit(2)) == 0, 5).otherwise(1)
    none = F.lit(None).cast("double")
    found = sc.judge_scores(F.col("subtask_score") / by, F.col("memory_score") / by, none, none, F.lit("?"))
    return px.judged(spark, d).select("doc_id", *[c.alias(n) for n, c in found.items()])


@query("f_snap4", """, q as (select event_id, case when v > 5 then v / 10 when v > 1 then v / 5 else v end as u from (select event_id, round(k / 10.0::double, 2) as v from f))
select event_id, case when round(abs(u), 9) <= round(abs(u - 0.4), 9) then 0.0 when round(abs(u - 0.4), 9) <= round(abs(u - 0.9), 9) then 0.4 when round(abs(u - 0.9), 9) <= round(abs(u - 1), 9) then 0.9 else 1.0 end::double as level from q""")
def snap4(spark, d):
    return px.frames(spark, d).select("event_id", sc.snap(F.round(F.col("k") / 10.0, 2)).alias("level"))


@query("f_exact_override", """, q as (select doc_id, case when doc_id % 4 = 0 then 5.0 else subtask_score end as s, case when doc_id % 5 = 0 then 5.0 else memory_score end as m, doc_id % 4 = 0 or doc_id % 5 = 0 as hit from j)
select doc_id, s as subtask_score, m as memory_score, s + m as total_score, case when not hit then 'kept' when s + m >= 9.999 then 'correct' when s + m <= 0 then 'wrong' else 'partial' end as verdict, hit as overridden, case when hit then 'char_match_override' else 'said' end as reason from q""")
def override(spark, d):
    found = sc.exact_override(F.col("subtask_score"), F.col("memory_score"), F.pmod("doc_id", F.lit(4)) == 0, F.pmod("doc_id", F.lit(5)) == 0, F.lit("kept"), F.lit("said"))
    return px.judged(spark, d).select("doc_id", *[c.alias(n) for n, c in found.items()])


#: Neighbours' scores from an event's number: none, one or both.
RELATION = """case when s >= 0.5 then 'not_needed' when p is null and n is null then 'unknown' when greatest(coalesce(p, -1), coalesce(n, -1)) < 0.5 then 'neither' when n is null then 'previous_subtask'
    when p is null then 'next_subtask' when abs(p - n) < 1e-6 then 'neither' when p > n then 'previous_subtask' else 'next_subtask' end"""


@query("f_neighbor_relation", f", q as (select event_id, (k % 10) / 10.0::double as s, case when k % 3 <> 0 then (k % 7) / 7.0::double end as p, case when k % 5 <> 0 then (k % 4) / 4.0::double end as n from f) select event_id, {RELATION} as relation from q")
def relation(spark, d):
    p, n = F.when(F.pmod("k", F.lit(3)) != 0, F.pmod("k", F.lit(7)) / 7.0), F.when(F.pmod("k", F.lit(5)) != 0, F.pmod("k", F.lit(4)) / 4.0)
    return px.frames(spark, d).select("event_id", sc.neighbor_relation(F.pmod("k", F.lit(10)) / 10.0, p, n).alias("relation"))


@query("f_dataset_seed", "select event_id, cast(('0x' || substr(sha256('42|' || event_type || '|' || k), 9, 8)) as bigint) as seed from f")
def dataset_seed(spark, d):
    return px.frames(spark, d).select("event_id", sc.dataset_seed(42, F.col("event_type"), F.col("k").cast("string")).alias("seed"))


@query("f_index_or_text", "select event_id, case event_id % 3 when 0 then k::varchar when 1 then 'none' else k::varchar end as out from f")
def index_or_text(spark, d):
    made = F.element_at(F.array(F.concat(F.lit(" x/episode_"), F.col("k").cast("string")), F.lit(" none "), F.concat(F.lit(" "), F.col("k").cast("string"))), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    return px.frames(spark, d).select("event_id", tx.index_or_text(made).alias("out"))


@query("f_hash_seed", "select event_id, cast(('0x' || left(md5(event_type || k), 8)) as bigint) as seed from f")
def seed(spark, d):
    return px.frames(spark, d).select("event_id", sc.hash_seed(F.concat("event_type", F.col("k").cast("string"))).alias("seed"))
