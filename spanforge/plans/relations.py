"""Queries on sources, joins, set operations and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import sampling as sm
from spanforge.operators import tables as tb
from spanforge.plans.registry import query
from spanforge.sources import proxies as px


@query("s_latest_by_key", "select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(value, (ts, event_id)) as value from events group by user_id", views=False)
def latest(spark, d):
    return tb.latest_by(px.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("s_chunk_path", "select distinct episode_index, printf('data/chunk-%03d/episode_%06d.parquet', episode_index // 50, episode_index) as path from f")
def chunk_path(spark, d):
    return px.frames(spark, d).select("episode_index", tb.chunk_path(F.col("episode_index"), 50).alias("path")).distinct()


@query("s_tolerant_json", "select event_id, k from f where k % 5 not in (0, 1)")
def tolerant(spark, d):
    line = F.when(F.pmod("k", F.lit(5)) == 0, "{broken").when(F.pmod("k", F.lit(5)) == 1, "[1]").otherwise(F.concat(F.lit('{"k": '), F.col("k"), F.lit("}")))
    return tb.json_objects(px.frames(spark, d).select("event_id", line.alias("line")), "line").select("event_id", F.get_json_object("line", "$.k").cast("long").alias("k"))


@query("s_tiered_match", """select episode_index, arg_min(event_id, (tier, event_id)) as event_id, min(tier) as tier from
    (select episode_index, event_id, case when k = 7 then 0 when k % 10 = 7 then 1 when k % 7 = 0 then 2 end as tier from f) where tier is not null group by episode_index""")
def tiered(spark, d):
    tests = [F.col("k") == 7, F.pmod("k", F.lit(10)) == 7, F.pmod("k", F.lit(7)) == 0]
    return tb.tiered_match(px.frames(spark, d), "episode_index", tests, "event_id")


@query("p_id_filter", "select episode_index, seg_id, text from s where episode_index in (3, 5, 12)")
def id_filter(spark, d):
    return px.segments(spark, d).filter(tb.id_filter(F.col("episode_index"), "3, episode_000005,x12,none")).select("episode_index", "seg_id", "text")


@query("p_config_filter", "select event_id from f where event_type = 'view' or event_type like '%\\_view' or event_type like 'click%' or event_type like '%ror'")
def config_filter(spark, d):
    t = F.col("event_type")
    return px.frames(spark, d).filter(tb.tagged(t, "view") | F.startswith(t, F.lit("click")) | F.endswith(t, F.lit("ror"))).select("event_id")


@query("p_closed_loop_sample", """select f.episode_index, frame_index, seg_id, text as gt, task, frame_index / 10.0::double as at from f join s on f.episode_index = s.episode_index and frame_index >= start_frame and frame_index < end_frame
    join e on e.episode_index = f.episode_index where text <> 'error'""")
def closed_loop(spark, d):
    from spanforge.operators.scan import scan_join

    held = scan_join(px.frames(spark, d).select("episode_index", "frame_index"), px.segments(spark, d))
    e = px.episodes(spark, d).select("episode_index", "task")
    at = F.coalesce(F.lit(None).cast("double"), F.col("frame_index") / 10.0)
    return held.join(e, "episode_index").filter("text <> 'error'").select("episode_index", "frame_index", "seg_id", F.col("text").alias("gt"), "task", at.alias("at"))


@query("j_broadcast_lookup", "select o_orderkey, coalesce(c_mktsegment, '') as segment from orders left join (select * from customer where c_custkey % 3 <> 0) on o_custkey = c_custkey", views=False)
def lookup(spark, d):
    some = px.table(spark, d, "customer").filter("c_custkey % 3 <> 0")
    return tb.lookup(px.table(spark, d, "orders"), "o_custkey", some, "c_custkey", "c_mktsegment", "").select("o_orderkey", F.col("c_mktsegment").alias("segment"))


@query("j_exists_flag", "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has from customer", views=False)
def exists(spark, d):
    return tb.exists_flag(px.table(spark, d, "customer"), "c_custkey", px.table(spark, d, "orders"), "o_custkey", "has").select("c_custkey", "has")


@query("j_resume_anti", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)", views=False)
def resume(spark, d):
    done = px.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return tb.without(px.table(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("j_anti_select", "select c_custkey from customer where c_custkey % 5 <> 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') order by c_custkey limit 20", views=False)
def anti_select(spark, d):
    c = px.table(spark, d, "customer").select("c_custkey")
    existing = px.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return tb.select_targets(c, "c_custkey", [c.filter("c_custkey % 5 = 0"), existing], most=20)


@query("j_fallback_fill", """select event_id, coalesce(nullif(case when k % 2 = 0 then -1 else k end, -1), nullif(case when event_id % 3 = 0 then -1 else event_id * 2 end, -1), event_id * 3) as filled from f""")
def fill(spark, d):
    f = px.frames(spark, d)
    rows = f.select("event_id", F.when(F.pmod("k", F.lit(2)) == 0, -1).otherwise(F.col("k")).alias("v"))
    a = f.select("event_id", F.when(F.pmod("event_id", F.lit(3)) == 0, -1).otherwise(F.col("event_id") * 2).alias("v"))
    b = f.select("event_id", (F.col("event_id") * 3).alias("v"))
    return tb.fill_missing(rows, "v", "event_id", [a, b]).select("event_id", F.col("v").alias("filled"))


@query("j_bisect_range", """, b as (select event_id, k % 4 as n, sum(k % 4) over (order by event_id) as hi from f)
select event_id, hi - n + i.i as sample, i.i as at from b, (select unnest(range(0, 4)) as i) i where i.i < n""")
def bisect(spark, d):
    blocks = px.frames(spark, d).select("event_id", F.pmod("k", F.lit(4)).alias("n"))
    ranges = tb.offsets(blocks, "event_id", "n")
    samples = ranges.select(F.explode(F.when(F.col("n") > 0, F.sequence("lo", F.col("hi") - 1))).alias("sample"))
    return tb.locate(samples, "sample", ranges).select("event_id", "sample", (F.col("sample") - F.col("lo")).alias("at"))


@query("j_asof_nearest", """, p as (select episode_index, frame_index * 7.3::double as t, frame_index as q from f), x as (select episode_index, frame_index, k * 1.0::double as kt from f)
select p.episode_index, q, arg_min(frame_index, (abs(kt - t), kt, frame_index)) as frame from p join x on p.episode_index = x.episode_index group by p.episode_index, q""")
def asof(spark, d):
    f = px.frames(spark, d)
    probes = f.select("episode_index", F.col("frame_index").alias("q"), (F.col("frame_index") * 7.3).alias("t"))
    stream = f.select("episode_index", "frame_index", F.col("k").cast("double").alias("kt"))
    return tb.nearest_asof(probes, "t", "q", stream, "kt", "frame_index", "episode_index").select("episode_index", "q", F.col("frame_index").alias("frame"))


@query("j_multiview_align", """, h as (select episode_index, frame_index as i, count(*) over (partition by episode_index) as n, value from f), w as (select episode_index, row_number() over (partition by episode_index order by frame_index) - 1 as i, count(*) over (partition by episode_index) as m, value from f where frame_index % 2 = 0)
select h.episode_index, h.i as frame, h.value as head, w.value as wrist from h left join w on w.episode_index = h.episode_index and w.i = cast(case when n <= 1 or m = 1 then 0 when n = m then h.i else round_even(h.i * (m - 1.0::double) / (n - 1), 0) end as bigint)""")
def multiview(spark, d):
    from pyspark.sql import Window

    f = px.frames(spark, d)
    wrist = f.filter("frame_index % 2 = 0")
    wrist = wrist.withColumn("i", (F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1).cast("long"))
    out = tb.align_views(f.select("episode_index", F.col("frame_index").alias("i"), "value"), wrist.select("episode_index", "i", F.col("value").alias("wrist")))
    return out.select("episode_index", F.col("i").alias("frame"), F.col("value").alias("head"), "wrist")


@query("j_multiview_both", """, h as (select episode_index, frame_index as i, count(*) over (partition by episode_index) as n, value from f), l as (select episode_index, row_number() over (partition by episode_index order by frame_index) - 1 as i, count(*) over (partition by episode_index) as m, value from f where frame_index % 2 = 0 and episode_index % 3 <> 0),
r as (select episode_index, row_number() over (partition by episode_index order by frame_index) - 1 as i, count(*) over (partition by episode_index) as m, value from f where frame_index % 3 = 1)
select h.episode_index, h.i as frame, l.value as left_wrist, r.value as right_wrist, 1 + (l.value is not null)::int + (r.value is not null)::int as views from h
left join l on l.episode_index = h.episode_index and l.i = cast(case when n <= 1 or l.m = 1 then 0 when n = l.m then h.i else round_even(h.i * (l.m - 1.0::double) / (n - 1), 0) end as bigint)
left join r on r.episode_index = h.episode_index and r.i = cast(case when n <= 1 or r.m = 1 then 0 when n = r.m then h.i else round_even(h.i * (r.m - 1.0::double) / (n - 1), 0) end as bigint)""")
def multiview_both(spark, d):
    from pyspark.sql import Window

    f = px.frames(spark, d)
    place = (F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1).cast("long")
    side = lambda rows, name: rows.withColumn("i", place).select("episode_index", "i", F.col("value").alias(name))
    out = tb.align_both(f.select("episode_index", F.col("frame_index").alias("i")), side(f.filter("frame_index % 2 = 0 and episode_index % 3 <> 0"), "left_wrist"), side(f.filter("frame_index % 3 = 1"), "right_wrist"))
    return out.select("episode_index", F.col("i").alias("frame"), "left_wrist", "right_wrist", "views")


@query("j_select_requested", "select 'asked' as kind, c_custkey from customer where c_custkey % 7 = 0 and c_custkey % 5 <> 0 and c_custkey not in (select o_custkey from orders) union all select 'overwrite', c_custkey from customer where c_custkey % 7 = 0 and c_custkey % 5 <> 0", views=False)
def select_requested(spark, d):
    c = px.table(spark, d, "customer").select("c_custkey")
    done = px.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    some = lambda o: tb.select_targets(c, "c_custkey", [c.filter("c_custkey % 5 = 0")], 3, c.filter("c_custkey % 7 = 0"), done, o)
    return some(False).withColumn("kind", F.lit("asked")).unionByName(some(True).withColumn("kind", F.lit("overwrite")))


@query("x_union_all", "select o_orderkey as id, 'o' as shard from orders union all select l_orderkey, 'l' from lineitem", views=False)
def union_all(spark, d):
    o = px.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("o").alias("shard"))
    return o.unionByName(px.table(spark, d, "lineitem").select(F.lit("l").alias("shard"), F.col("l_orderkey").alias("id")))


def _sets(spark, d):
    return px.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), px.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))


_a, _b = "select o_custkey as id from orders", "select c_custkey as id from customer"


@query("x_union_distinct", f"{_a} union {_b}", views=False)
def union_distinct(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


@query("x_except", f"{_b} except {_a}", views=False)
def except_(spark, d):
    a, b = _sets(spark, d)
    return tb.without(b, a, ["id"]).distinct()


@query("x_intersect", f"{_a} intersect {_b}", views=False)
def intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


@query("k_upsert", """select o_custkey as id, round(sum(o_totalprice), 4) as total, 'new' as src from orders where o_orderstatus = 'O' group by all
    union all select c_custkey, round(c_acctbal, 4), 'old' from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'O')""", views=False)
def upsert(spark, d):
    old = px.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("total"), F.lit("old").alias("src"))
    new = px.table(spark, d, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("total"), F.lit("new").alias("src"))
    return tb.upsert(old, new, ["id"]).withColumn("total", F.round("total", 4))


_SEEDED = "select *, row_number() over (partition by {g} order by md5({s} || '|' || {g} || '|' || {k}), {k}) as r from {t}"


@query("o_sample_per_group", "select c_custkey, c_mktsegment from (" + _SEEDED.format(g="c_mktsegment", s="'s'", k="c_custkey", t="customer") + ") where r <= 7", views=False)
def per_group(spark, d):
    return sm.per_group(px.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 7, "s")


@query("o_sampling_rate", "select c_custkey, unnest(range(1, cast(rate as bigint) + 1 + (r <= floor(round(n * (rate - floor(rate)), 9)))::int)) as copy from (select *, count(*) over (partition by c_mktsegment) as n, case c_mktsegment when 'BUILDING' then 2.25 when 'MACHINERY' then 1.0 else 0.5 end::double as rate from ("
       + _SEEDED.format(g="c_mktsegment", s="'s'", k="c_custkey", t="customer") + "))", views=False)
def at_rate(spark, d):
    rate = F.when(F.col("c_mktsegment") == "BUILDING", 2.25).when(F.col("c_mktsegment") == "MACHINERY", 1.0).otherwise(0.5)
    return sm.at_rate(px.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", rate, "s").select("c_custkey", "copy")


@query("o_quota_sample", "select c_custkey, c_nationkey from (" + _SEEDED.format(g="c_nationkey", s="'q'", k="c_custkey", t="customer") + ") where r <= (select 100 // count(distinct c_nationkey) from customer)", views=False)
def quota(spark, d):
    return sm.quota(px.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 100, "q")


@query("o_topk_candidates", """, x as (select episode_index, length, length // 2 as expected from e), r as (select f.episode_index, frame_index, length, row_number() over (partition by f.episode_index order by value, abs(frame_index - expected), frame_index) as r from f join x using (episode_index)),
u as (select episode_index, frame_index, length from r where r <= 5 union all select episode_index, expected, length from x)
select distinct episode_index, least(greatest(frame_index, 1), length - 1) as frame_index from u""")
def topk(spark, d):
    expected = px.episodes(spark, d).select("episode_index", F.floor(F.col("length") / 2).alias("expected"), "length")
    return sm.top_candidates(px.frames(spark, d), "value", expected, 5)
