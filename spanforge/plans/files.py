"""Queries that write the test tables in a dataset's layouts and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.plans.registry import query
from spanforge.sinks import writers as wr
from spanforge.sources import configs as cf
from spanforge.sources import episodes as es
from spanforge.sources import files as fl
from spanforge.sources import proxies as px

EPISODE_LIST = """, el as (select episode_index, string_agg(seg_id || ':' || start_frame || '-' || end_frame || ' ' || text, '|' order by seg_id) as config from s group by episode_index)
"""


def _config(column="action_config"):
    one = lambda x: F.concat(x["seg_id"].cast("string"), F.lit(":"), x["start_frame"].cast("string"), F.lit("-"), x["end_frame"].cast("string"), F.lit(" "), x["text"])
    return F.array_join(F.transform(column, one), "|")


SEGMENT = "struct<seg_id:long,start_frame:long,end_frame:long,text:string,skill:string>"
EPISODE = f"episode_index long, length long, task string, action_config array<{SEGMENT}>"


@query("s_read_jsonl", EPISODE_LIST + "select episode_index, length, task, config from e join el using (episode_index)")
def read_jsonl(spark, d):
    out = wr.scratch(spark, "jsonl")
    wr.append_records(px.episodes(spark, d), out)
    return fl.read_jsonl(spark, out, EPISODE).select("episode_index", "length", "task", _config().alias("config"))


def _document(rows, *keep):
    """All rows as one JSON text."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*keep)))).alias("value"))


@query("s_read_json", "select episode_index, length from e")
def read_json(spark, d):
    out = wr.scratch(spark, "json")
    _document(px.episodes(spark, d), "episode_index", "length").coalesce(1).write.text(out)
    return fl.read_json(spark, out, "episode_index long, length long")


@query("s_load_annotation", "select k.kind, episode_index, length from e, (values ('list'), ('episodes'), ('annotations'), ('jsonl')) k(kind)")
def load_annotation(spark, d):
    root, e = wr.scratch(spark, "annotation"), px.episodes(spark, d)
    one, found = _document(e, "episode_index", "length"), []
    wrap = {"list": F.col("value"), "episodes": F.concat(F.lit('{"data": 3, "episodes": '), "value", F.lit(', "annotations": []}')), "annotations": F.concat(F.lit('{"annotations":'), "value", F.lit("}"))}
    for kind, text in wrap.items():
        one.select(text.alias("value")).coalesce(1).write.text(f"{root}/{kind}")
        found.append(fl.load_annotation(spark, f"{root}/{kind}").select(F.lit(kind).alias("kind"), "json"))
    e.select("episode_index", "length").write.json(f"{root}/x.jsonl")
    found.append(fl.load_annotation(spark, f"{root}/x.jsonl").select(F.lit("jsonl").alias("kind"), "json"))
    rows = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return rows.select("kind", *[F.get_json_object("json", f"$.{c}").cast("long").alias(c) for c in ("episode_index", "length")])


@query("s_json_or_jsonl", "select k.kind, episode_index, task from e, (values ('array'), ('lines')) k(kind)")
def json_or_jsonl(spark, d):
    root, e = wr.scratch(spark, "either"), px.episodes(spark, d).select("episode_index", "task")
    _document(e, "episode_index", "task").coalesce(1).write.text(f"{root}/array")
    e.coalesce(1).select(F.to_json(F.struct("*")).alias("v")).select(F.concat("v", F.lit("\n  ")).alias("value")).write.text(f"{root}/lines")
    rows = [fl.read_json_or_jsonl(spark, f"{root}/{k}").select(F.lit(k).alias("kind"), "json") for k in ("array", "lines")]
    return rows[0].unionByName(rows[1]).select("kind", F.get_json_object("json", "$.episode_index").cast("long").alias("episode_index"), F.get_json_object("json", "$.task").alias("task"))


def _write_episodes(spark, d, root):
    """Each episode's frames as a file of its own, named as datasets name them."""
    f = px.frames(spark, d).select("episode_index", "frame_index", "value", F.array("value", F.col("k").cast("double")).alias("state"))
    wr.write_episode_files(f, f"{root}/data", 50)
    return f"{root}/data"


@query("s_episode_files", "select episode_index, frame_index, value, round(value + k, 6) as both, 2 as size from f")
def episode_files(spark, d):
    rows = fl.read_episodes(spark, _write_episodes(spark, d, wr.scratch(spark, "frames")))
    some = fl.available(rows, ["episode_index", "frame_index", "state", "value", "no_such_column"])
    m, one = fl.column_matrix(some, "state"), fl.column_matrix(some, "value")
    return some.select("episode_index", "frame_index", "value", F.round(F.col("state")[0] + F.col("state")[1], 6).alias("both"), (F.size(m) * F.size(one)).cast("long").alias("size"))


@query("s_list_episodes", "select episode_index, printf('chunk-%03d/episode_%06d.parquet', episode_index // 50, episode_index) as path from e")
def list_episodes(spark, d):
    root = _write_episodes(spark, d, wr.scratch(spark, "list"))
    return fl.list_episodes(spark, root).select("episode_index", F.regexp_extract("path", "(chunk-[^/]+/[^/]+)$", 1).alias("path"))


@query("s_info_fps", """select event_id, case k % 6 when 0 then k / 2.0::double when 1 then 24.0 when 2 then 25.5 when 3 then 12.0 when 4 then 30.0 else 15.0 end::double as fps,
    case k % 6 when 0 then k / 2.0::double when 1 then 30.0 when 2 then 25.5 when 3 then 12.0 when 4 then 30.0 else 15.0 end::double as first_readable from f""")
def info_fps(spark, d):
    m = F.pmod("k", F.lit(6))
    infos = (
        F.when(m == 1, F.array(F.lit(None), F.lit('{"features": {"a": {"x": 1}}}'), F.lit('{"fps": 24}'))).when(m == 2, F.array(F.lit("{broken"), F.lit('{"features": {"a": {}, "b": {"video_info": {"video.fps": 25.5}}, "c": {"info": {"video.fps": 9}}}}')))
        .when(m == 3, F.array(F.lit('{"features": {"c": {"info": {"video.fps": 12}}}}'), F.lit('{"fps": 50}'))).when(m == 5, F.array(F.lit('{"fps": "15"}'))).otherwise(F.array(F.lit(None).cast("string")))
    )
    own = F.when(m == 0, F.col("k") / 2.0)
    return px.frames(spark, d).select("event_id", fl.resolve_fps(own, infos, F.lit(30.0)).alias("fps"), fl.resolve_fps(own, infos, F.lit(30.0), True).alias("first_readable"))


@query("s_dataset_infos", """select c_custkey, case when c_custkey % 3 = 0 then c_custkey % 50 + 1.0 when c_custkey % 5 = 0 then 7.0 else 30.0 end::double as fps from customer""", views=False)
def dataset_infos(spark, d):
    c = px.table(spark, d, "customer")
    own = F.concat(F.lit("root/d"), F.col("c_custkey").cast("string"))
    three = c.filter("c_custkey % 3 = 0").select(F.concat(own, F.lit("/info.json")).alias("path"), F.concat(F.lit('{"fps": '), F.pmod("c_custkey", F.lit(50)) + 1, F.lit("}")).alias("text"))
    near = c.filter("c_custkey % 3 <> 0 and c_custkey % 5 = 0").select(F.concat(F.lit("near"), F.col("c_custkey").cast("string"), F.lit("/meta/info.json")).alias("path"), F.lit('{"fps": 7}').alias("text"))
    path = F.when((F.pmod("c_custkey", F.lit(3)) != 0) & (F.pmod("c_custkey", F.lit(5)) == 0), F.concat(F.lit("near"), F.col("c_custkey").cast("string"), F.lit("/x/"))).otherwise(own)
    rows = fl.with_infos(c.select("c_custkey", path.alias("data_path")), three.unionByName(near), fl.info_candidates(F.col("data_path")))
    return rows.select("c_custkey", fl.resolve_fps(F.lit(None).cast("double"), F.col("infos"), F.lit(30.0)).alias("fps"))


@query("s_list_tasks", "select distinct event_type || '_' || (k % 3) || '_Task' as prefix, event_type || ' task' as task from f")
def list_tasks(spark, d):
    path = F.concat(F.lit("s3a://b/root/"), "event_type", F.lit("_"), F.pmod("k", F.lit(3)).cast("string"), F.lit("_Task/x/y.mp4"))
    return fl.list_tasks(px.frames(spark, d).select(path.alias("path")), "s3a://b/root")


@query("s_blobs", "select 'part' as kind, count(*) > 0 as some, bool_and(true) as whole from region", views=False)
def blobs(spark, d):
    out = wr.scratch(spark, "blobs")
    px.table(spark, d, "region").coalesce(1).write.json(out)
    b = fl.read_blobs(spark, out, "part-*")
    return b.agg(F.lit("part").alias("kind"), (F.count(F.lit(1)) > 0).alias("some"), F.bool_and(F.length("content") == F.col("length")).alias("whole"))


@query("s_list_videos", "select printf('episode_%06d.mp4', e.episode_index) as name, episode_index, length, episode_index % 2 = 0 as annotated from e where episode_index > 0")
def list_videos(spark, d):
    e = px.episodes(spark, d)
    name = F.format_string("%06d", "episode_index")
    videos = e.select(F.concat(F.lit("v/episode_"), name, F.when(F.col("episode_index") > 0, ".mp4").otherwise(".mp4/../x")).alias("path"), "length")
    notes = e.filter("episode_index % 2 = 0").select(F.concat(F.lit("a/episode_"), name, F.lit(".json")).alias("path"), "length")
    return fl.list_videos(videos, notes.unionByName(notes))


#: Files of three cameras: one exact, one by its last part twice, one only within a name, one nowhere.


def _listing(spark, d):
    """A listing of videos: each customer is an episode, some without a left view, some with two, some with two right ones."""
    c = px.table(spark, d, "customer").select(F.col("c_custkey").alias("i"))
    name = lambda form: F.format_string(form, F.col("i"))
    held = [
        name("r/cam_high/episode_%06d.mp4"), name("r/my_right_cam/ep-%06d.MKV"), F.when(F.pmod("i", F.lit(5)) != 0, name("r/left/episode_%06d.mp4")), F.when(F.pmod("i", F.lit(7)) == 0, name("b/left/episode_%06d.mov")),
        F.when(F.pmod("i", F.lit(11)) == 0, name("b/right_too/%06d/Episode%08d.webm".replace("%06d", "x"))), name("r/gripper/episode_%06d.txt"),
    ]
    return c.select("i", F.explode(F.array_compact(F.array(*held))).alias("path"))


@query("s_discover_videos", """with c as (select c_custkey as i, printf('%06d', c_custkey) as n from customer)
select i as episode_index, 'observation.cam_high' as key, 'r/cam_high/episode_' || n || '.mp4' as path, null as issue from c
union all select i, 'right', case when i % 11 <> 0 then 'r/my_right_cam/ep-' || n || '.MKV' end, case when i % 11 = 0 then 'ambiguous_fuzzy' end from c
union all select i, 'left', case when i % 5 <> 0 and i % 7 <> 0 then 'r/left/episode_' || n || '.mp4' when i % 5 = 0 and i % 7 = 0 then 'b/left/episode_' || n || '.mov' end,
    case when i % 5 = 0 and i % 7 <> 0 then 'missing' when i % 5 <> 0 and i % 7 = 0 then 'ambiguous_exact' end from c
union all select i, 'gripper', null, 'missing' from c""", views=False)
def discover(spark, d):
    files = _listing(spark, d)
    return fl.discover_each(files, ["observation.cam_high", "left", "right", "gripper"], files.select(F.col("i").alias("episode_index")))


@query("s_ambiguous_videos", """select 'cam_high' as key, null as path, 'ambiguous_exact' as issue union all select 'ation', null, 'ambiguous_fuzzy' union all select 'cam.' || n_name, 'r/cam_high/' || n_name || '.mp4', null from nation where n_nationkey = 7
union all select 'wrist', null, 'missing'""", views=False)
def ambiguous(spark, d):
    n = px.table(spark, d, "nation")
    one = n.filter("n_nationkey = 7").first()["n_name"]  # a row of the nations, of which there are 25
    files = n.select(F.concat(F.lit("r/cam_high/"), "n_name", F.lit(".mp4")).alias("path")).union(n.select(F.concat(F.lit("stations/"), F.col("n_nationkey").cast("string"), F.lit("/clip.mov"))))
    return fl.discover_videos(files, ["cam_high", "ation", f"cam.{one}", "wrist"])


@query("s_sibling_views", """with c as (select c_custkey as i, 'r' || c_custkey as r, 'q' || c_custkey as q from customer)
select r || '/observation.images.cam_high/e.mp4' as path, 'head' as view, r || '/observation.images.cam_high/e.mp4' as view_path from c union all select r || '/observation.images.cam_high/e.mp4', 'left', r || '/observation.images.cam_left_wrist/e.mp4' from c where i % 2 = 0
union all select r || '/observation.images.cam_high/e.mp4', 'right', r || '/observation.images.cam_right_wrist/e.mp4' from c where i % 3 = 0
union all select q || '/top/e.mp4', 'head', q || '/top/e.mp4' from c union all select q || '/top/e.mp4', 'right', q || case when i % 5 = 0 then '/a_Right_Wrist/e.mp4' else '/b_right_wrist/e.mp4' end from c""", views=False)
def siblings(spark, d):
    c = px.table(spark, d, "customer").select(F.col("c_custkey").alias("i"))
    at = lambda root, rest: F.concat(F.lit(root), F.col("i").cast("string"), F.lit(rest))
    heads = c.select(F.explode(F.array(at("r", "/observation.images.cam_high/e.mp4"), at("q", "/top/e.mp4"))).alias("path"))
    wrists = [F.when(F.pmod("i", F.lit(k)) == 0, at(r, f"/{x}/e.mp4")) for r, k, x in (("r", 2, "observation.images.cam_left_wrist"), ("r", 3, "observation.images.cam_right_wrist"), ("q", 5, "a_Right_Wrist"), ("q", 1, "b_right_wrist"))]
    other = c.select(F.explode(F.array_compact(F.array(*wrists, at("q", "/left_wrist/other.mp4")))).alias("path"))
    return fl.sibling_views(heads, heads.union(other))


@query("s_registry", "select * from (values ('BUILDING', 0.25::double), ('MACHINERY', 1.0::double)) v(dataset_name, sampling_rate)", views=False)
def registry(spark, d):
    return cf.from_registry(px.table(spark, d, "customer").select(F.col("c_mktsegment").alias("dataset_name")).distinct(), ["BUILDING%25", "MACHINERY"])


@query("s_inline_configs", "select r_regionkey::bigint as pos, r_name || '/x/e.jsonl' as annotation_path, case when r_regionkey % 2 = 0 then r_name || '/x' else '/v' end as data_path, (r_regionkey + 8)::varchar as step from region", views=False)
def inline(spark, d):
    r = px.table(spark, d, "region").orderBy("r_regionkey").collect()  # the regions, of which there are 5, as a line of text
    text = ", ".join(f" annotation_path={x['r_name']}/x/e.jsonl ; sample_interleave = {x['r_regionkey'] + 8}{';data_path=/v' if x['r_regionkey'] % 2 else ''}" for x in r)
    rows = cf.resolve_configs(spark, text + ",")
    return rows.select("pos", *[F.col("config")[c].alias(n) for c, n in (("annotation_path", "annotation_path"), ("data_path", "data_path"), ("sample_interleave", "step"))])


@query("s_config_file", "select k.kind, n_nationkey from nation, (values ('list'), ('datasets')) k(kind) union all select 'one', min(n_nationkey) from nation", views=False)
def config_file(spark, d):
    root, found = wr.scratch(spark, "configs"), []
    n = px.table(spark, d, "nation")
    one = _document(n, "n_nationkey")  # a file holds one document: here the 25 nations
    single = n.agg(F.to_json(F.struct(F.min("n_nationkey").alias("n_nationkey"))).alias("value"))
    for kind, rows in {"list": one, "datasets": one.select(F.concat(F.lit('{"datasets":'), "value", F.lit("}")).alias("value")), "one": single}.items():
        rows.coalesce(1).write.text(f"{root}/{kind}")
        found.append(cf.resolve_configs(spark, path=f"{root}/{kind}").select(F.lit(kind).alias("kind"), F.col("config")["n_nationkey"].cast("int").alias("n_nationkey")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def _configs(spark, d):
    """A dataset for each customer, named by its segment, number and kind of task."""
    kind = F.element_at(F.array(F.lit("spatial"), F.lit("Counting"), F.lit("long")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    c = px.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pos"), F.concat_ws("-", F.lower("c_mktsegment"), F.when(F.col("c_custkey") > 20, F.col("c_custkey").cast("string")), kind).alias("dataset_name"), F.lower(kind).alias("task_type"))


CONFIGS = """with g as (select c_custkey as pos, lower(c_mktsegment) || case when c_custkey > 20 then '-' || c_custkey else '' end || '-' || ['spatial', 'Counting', 'long'][c_custkey % 3 + 1] as dataset_name, ['spatial', 'counting', 'long'][c_custkey % 3 + 1] as task_type, lower(c_mktsegment) as m from customer)
"""


@query("p_config_pick", CONFIGS + """select 'tag' as how, min(pos) as pos, arg_min(dataset_name, pos) as dataset_name from g where m = 'building' and pos <= 20 having count(*) > 0
union all select 'prefix', min(pos), arg_min(dataset_name, pos) from g where m = 'machinery' and pos > 20 and dataset_name like 'machinery-2%' and task_type = 'long' having count(*) > 0
union all select 'name', pos, dataset_name from g where pos = 33""", views=False)
def pick(spark, d):
    c = _configs(spark, d)
    name = c.filter("pos = 33").first()["dataset_name"]  # of one customer
    some = c.filter("dataset_name like 'machinery-2%' and task_type = 'long' and pos > 20")
    found = [cf.pick_config(c, "Building").withColumn("how", F.lit("tag")), cf.pick_config(some, "MACHINERY").withColumn("how", F.lit("prefix")), cf.pick_config(c, "", name.upper().replace("-", "_")).withColumn("how", F.lit("name")), cf.pick_config(c, "nothing").withColumn("how", F.lit("none"))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("how", "pos", "dataset_name")


@query("p_config_slice", CONFIGS + "select pos, dataset_name from g where task_type = 'counting' and dataset_name like 'building%'", views=False)
def config_slice(spark, d):
    c = _configs(spark, d).withColumn("dataset_name", F.replace("dataset_name", F.lit("-"), F.lit("_")))
    return cf.slice_configs(c, "counting", "building").select("pos", F.replace("dataset_name", F.lit("_"), F.lit("-")).alias("dataset_name"))


@query("s_task_map", "select c_custkey, n_name as task from customer join nation on n_nationkey = c_nationkey", views=False)
def task_map(spark, d):
    root = wr.scratch(spark, "tasks")
    px.table(spark, d, "nation").select(F.col("n_nationkey").alias("task_index"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("task")).write.json(f"{root}/meta/tasks.jsonl")
    tasks = es.read_task_map(spark, root)
    return px.table(spark, d, "customer").join(tasks, F.col("c_nationkey") == F.col("task_index")).select("c_custkey", "task")


@query("k_save_posted", """, p as (select episode_index, length, n, episode_index * 3 + n as number, case when n = 0 then 'ok' else ['ok', 'missing body', 'invalid length', 'too long', 'no JSON', 'no object', 'not_covered', 'empty'][cast(episode_index % 8 + 1 as int)] end as error from e, (values (0), (1)) v(n)),
good as (select episode_index, max(n) as n from p where error = 'ok' group by episode_index)
select 'told' as kind, number, episode_index, nullif(error, 'ok') as error, null as text from p
union all select 'saved', null, good.episode_index, null, string_agg(seg_id || ':' || start_frame || '-' || end_frame || ' ' || case when n = 0 then text else 'new' end, '|' order by seg_id) from good join s on s.episode_index = good.episode_index group by good.episode_index, n""")
def save_posted(spark, d):
    from spanforge.sinks.posted import SAVED, save

    e, out = px.episodes(spark, d), wr.scratch(spark, "posted")
    body = lambda text, config="action_config": F.to_json(F.struct(F.lit(" go ").alias("task_text"), F.transform(config, lambda x: F.struct(x["end_frame"].cast("string").alias("end_frame"), F.concat(F.lit(" "), text(x)).alias("action_text"), x["skill"].alias("skill"))).alias("action_config")))
    e = e.withColumn("first", F.slice("action_config", F.lit(1), F.size("action_config") - 1)).withColumn("none", F.slice("action_config", 1, 0))
    good, m = body(lambda x: F.lit("new")), F.pmod("episode_index", F.lit(8))
    bad = F.when(m == 4, F.lit("{oops")).when(m == 5, F.lit("[1]")).when(m == 6, body(lambda x: F.lit("new"), "first")).when(m == 7, body(lambda x: F.lit("new"), "none")).otherwise(good)
    header = F.when(m == 1, F.lit(" ")).when(m == 2, F.lit("many")).when(m == 3, F.lit("10485761")).otherwise(F.length(bad).cast("string"))
    lengths = e.select("episode_index", "length")
    first = body(lambda x: x["text"])
    a = save(e.select((F.col("episode_index") * 3).alias("number"), "episode_index", F.length(first).cast("string").alias("header"), first.cast("binary").alias("body")), lengths, out)
    b = save(e.select((F.col("episode_index") * 3 + 1).alias("number"), "episode_index", header.alias("header"), bad.cast("binary").alias("body")), lengths, out)
    config = F.array_join(F.transform("action_config", lambda x: F.concat(x["seg_id"].cast("string"), F.lit(":"), x["start_frame"].cast("string"), F.lit("-"), x["end_frame"].cast("string"), F.lit(" "), x["action_text"])), "|")
    saved = spark.read.schema(SAVED).json(out).select(F.lit("saved").alias("kind"), F.lit(None).cast("long").alias("number"), "episode_index", F.lit(None).cast("string").alias("error"), config.alias("text"))
    return a.union(b).select(F.lit("told").alias("kind"), "number", "episode_index", "error", F.lit(None).cast("string").alias("text")).unionByName(saved)


@query("j_config_episodes", "select o_orderkey, o_orderpriority, o_totalprice * case when o_orderpriority = '1-URGENT' then 2 else 1 end as weighted from orders where o_orderpriority < '4'", views=False)
def config_episodes(spark, d):
    o = px.table(spark, d, "orders").withColumn("dataset_name", F.col("o_orderpriority"))
    c = o.select("dataset_name").distinct().filter("dataset_name < '4'").withColumn("rate", F.when(F.col("dataset_name") == "1-URGENT", 2).otherwise(1))
    return cf.with_config(o, c).select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") * F.col("rate")).alias("weighted"))


@query("s_episodes_source", EPISODE_LIST + """select episode_index, length, task, config, 12.5::double as fps, episode_index // 50 as chunk, printf('data/chunk-%03d/episode_%06d.parquet', episode_index // 50, episode_index) as data_path from e join el using (episode_index)""")
def episodes_source(spark, d):
    root = wr.scratch(spark, "dataset")
    e = px.episodes(spark, d)
    config = F.transform("action_config", lambda x: F.struct(x["seg_id"].alias("seg_id"), x["start_frame"].alias("start_frame"), x["end_frame"].alias("end_frame"), x["text"].alias("action_text"), x["skill"].alias("skill")))
    rows = e.select("episode_index", "length", F.array("task").alias("tasks"), config.alias("action_config")).coalesce(1)
    wr.append_records(rows, f"{root}/parts")
    info = '{"chunks_size": 50, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "features": {"a": {"video_info": {"video.fps": 12.5}}}}'
    spark.createDataFrame([(info,)], "value string").coalesce(1).write.text(f"{root}/info")
    fs = spark._jvm.org.apache.hadoop.fs
    store = fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(fs.Path(f"{root}/meta"))
    for kind, to in (("parts", "episodes.jsonl"), ("info", "info.json")):
        store.rename(store.globStatus(fs.Path(f"{root}/{kind}/part-*"))[0].getPath(), fs.Path(f"{root}/meta/{to}"))
    found = es.read_dataset(spark, root)
    text = F.transform("action_config", lambda x: F.concat(x["seg_id"].cast("string"), F.lit(":"), x["start_frame"].cast("string"), F.lit("-"), x["end_frame"].cast("string"), F.lit(" "), x["action_text"]))
    return found.select("episode_index", "length", F.col("tasks")[0].alias("task"), F.array_join(text, "|").alias("config"), "fps", "chunk", "data_path")


@query("k_write_annotations", "select 'kept' as kind, episode_index, length from e where episode_index % 7 <> 0 union all select 'wrong', episode_index, null from e where episode_index % 7 = 0")
def write_annotations(spark, d):
    out = wr.scratch(spark, "annotations")
    e = px.episodes(spark, d).withColumn("length", F.col("length") + (F.pmod("episode_index", F.lit(7)) == 0).cast("long"))
    wrong = wr.write_annotations(e, out)
    kept = fl.read_jsonl(spark, out, EPISODE).select(F.lit("kept").alias("kind"), "episode_index", "length")
    return kept.unionByName(wrong.select(F.lit("wrong").alias("kind"), "episode_index", F.lit(None).cast("long").alias("length")))


@query("k_summary", """select episode_index, case when episode_index % 3 = 0 then length + 1 else length end as length, '[' || length || ',' || episode_index || ']' as boundaries, 'kept' as mark from e union all
    select episode_index, case when episode_index % 3 = 0 then length + 1 else length end, '[' || length || ',' || episode_index || ']', 'csv' from e""")
def summary(spark, d):
    out = wr.scratch(spark, "summary")
    e = px.episodes(spark, d).select("episode_index", "length", F.array("length", "episode_index").alias("boundaries"), F.lit(0.5).alias("mean_confidence"))
    wr.write_summary(e, out)
    merged = wr.write_summary(e.filter("episode_index % 3 = 0").withColumn("length", F.col("length") + 1), out)
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{out}/summary.csv")
    a = merged.select("episode_index", "length", F.to_json("boundaries").alias("boundaries"), F.lit("kept").alias("mark"))
    return a.unionByName(csv.select(F.col("episode_index").cast("long"), F.col("length").cast("long"), "boundaries", F.lit("csv").alias("mark")))


@query("k_merge_shards", "select o_orderkey, case when o_orderkey % 3 = 2 then 2 else o_orderkey % 3 end as rank from orders", views=False)
def merge_shards(spark, d):
    root, o = wr.scratch(spark, "shards"), px.table(spark, d, "orders")
    for i in (0, 1, 2):
        o.filter(F.pmod("o_orderkey", F.lit(3)) == i).select("o_orderkey").write.json(f"{root}/{i}")
    return wr.merge_shards(spark, [f"{root}/0", f"{root}/1", f"{root}/2", f"{root}/lost"], "o_orderkey long").withColumn("rank", F.col("rank").cast("long"))


@query("k_rewrite_sorted", "select event_id, row_number() over (order by k, event_id) as place from f where event_id % 4 <> 0")
def rewrite_sorted(spark, d):
    out = wr.scratch(spark, "sorted")
    line = F.when(F.pmod("event_id", F.lit(4)) == 0, F.when(F.col("k") > 20, "{broken").otherwise("[3]")).otherwise(F.to_json(F.struct("event_id", F.col("k").alias("index"))))
    px.frames(spark, d).select(line.alias("value")).write.text(out)
    rows = wr.rewrite_sorted(spark, out, "event_id long, index long", "index", "event_id")
    return wr.written_places(rows).select("event_id", "place")


@query("k_processed", "select 'done' as kind, c_custkey from customer where c_custkey % 4 = 0 or c_custkey % 6 = 0 union all select 'left', c_custkey from customer where c_custkey % 4 <> 0 and c_custkey % 6 <> 0", views=False)
def processed(spark, d):
    out, c = wr.scratch(spark, "processed"), px.table(spark, d, "customer").select("c_custkey")
    wr.not_processed(c, out, "c_custkey")  # nothing is there yet
    wr.mark_processed(c.filter("c_custkey % 4 = 0"), out, "c_custkey")
    done = wr.mark_processed(c.filter("c_custkey % 6 = 0"), out, "c_custkey")
    left = wr.not_processed(c, out, "c_custkey")
    return done.select(F.lit("done").alias("kind"), "c_custkey").unionByName(left.select(F.lit("left").alias("kind"), "c_custkey"))


@query("k_cache", "select k.kind, c_custkey, case when k.kind = 'forced' then 3 else 1 end as made from customer, (values ('first'), ('again'), ('forced')) k(kind)", views=False)
def cache(spark, d):
    root, made = wr.scratch(spark, "cache"), []

    def make():
        made.append(1)
        return px.table(spark, d, "customer").select("c_custkey", F.lit(len(made)).alias("n"))

    key = {"cameras": "head,left", "stride": 3, "size": "32x32"}
    first = wr.cached(spark, root, key, make).select(F.lit("first").alias("kind"), "c_custkey", "n")
    wr.cached(spark, root, key | {"stride": 4}, make)
    again = wr.cached(spark, root, key, make).select(F.lit("again").alias("kind"), "c_custkey", "n")
    kept = wr.scratch(spark, "kept")
    first.unionByName(again).write.parquet(kept)
    forced = wr.cached(spark, root, key, make, force=True).select(F.lit("forced").alias("kind"), "c_custkey", "n")
    return spark.read.parquet(kept).unionByName(forced).select("kind", "c_custkey", F.col("n").cast("long").alias("made"))


@query("k_trace", "select conv_id, turn, row_number() over (partition by conv_id order by turn) as step_id from conversations", views=False)
def trace(spark, d):
    return wr.trace_records(px.table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
