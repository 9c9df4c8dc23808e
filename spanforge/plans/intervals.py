"""Queries on intervals: construction, validation, rewriting, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import intervals as iv
from spanforge.operators.scan import scan_join
from spanforge.plans.registry import query
from spanforge.sources import proxies as px

#: Windows and blocks of the proxy configuration: fps 10; steps 3, 2, 1; tails of 3, 2, 3 frames, 1 ignored.
WINDOWS = """, l as (select *, lag(start_frame) over w as ps, lead(seg_id) over w is null as last from s window w as (partition by episode_index order by seg_id)),
t as (select *, case when ps is not null then least(end_frame, start_frame + 2) end as tb from l where end_frame > start_frame),
u as (select *, coalesce(tb, start_frame) as ss, greatest(coalesce(tb, start_frame), end_frame - 3) as se from t),
win as (select episode_index, seg_id, 'transition' as kind, seg_id as target, seg_id - 1 as memory, greatest(start_frame - 3, ps) as a, tb as b,
    greatest(start_frame - 3, ps) as lo, tb as hi, 2 as step from u where ps is not null
  union all select episode_index, seg_id, 'uniform', seg_id, seg_id, ss, se, ss + case when ps is null then 0 else 1 end, se - 1, 3 from u
  union all select episode_index, seg_id, 'final_tail', seg_id + 1, seg_id, se, end_frame, se, end_frame, 1 from u where last)
"""
BLOCKS = WINDOWS + """, g as (select *, greatest(0, cast(ceil((b - a) / step) as bigint)) as m from win),
g1 as (select *, least(greatest(cast(ceil((lo - a) / step) as bigint), 0), m) as fi from g),
g2 as (select *, least(greatest(cast(ceil((hi - a) / step) as bigint), fi), m) as la from g1),
blk as (select episode_index, seg_id, kind, target, memory, a + fi * step as first_frame, step, la - fi as n from g2 where la > fi)
"""


def _windows(spark, d):
    return iv.sampling_windows(px.segments(spark, d), px.CONFIG)


def _blocks(spark, d):
    return iv.sampling_blocks(px.segments(spark, d), px.CONFIG)


query("i_sampling_blocks", BLOCKS + "select episode_index, seg_id, kind, target, memory, first_frame, cast(step as bigint) as step, n from blk")(_blocks)


@query("i_expand_frames", BLOCKS + "select episode_index, seg_id, kind, target, unnest(generate_series(first_frame, first_frame + (n - 1) * step, step)) as frame from blk")
def expand(spark, d):
    return iv.expand_frames(_blocks(spark, d))


@query("a_block_stats", BLOCKS + "select kind, cast(sum(n) as bigint) as frames, count(*) as blocks from blk group by kind")
def block_stats(spark, d):
    return iv.block_stats(_blocks(spark, d))


@query("i_resolve_target", WINDOWS + """, h as (select f.episode_index, f.frame_index, w.target, w.kind, w.seg_id, case kind when 'transition' then 0 when 'uniform' then 1 else 2 end as o
    from f left join win w on f.episode_index = w.episode_index and frame_index >= lo and frame_index < hi)
select episode_index, frame_index, arg_min(target, (seg_id, o)) as target, arg_min(kind, (seg_id, o)) as kind from h group by all""")
def resolve(spark, d):
    return iv.resolve_targets(px.frames(spark, d).select("episode_index", "frame_index"), _windows(spark, d))


@query("i_random_window_sample", WINDOWS + """select episode_index, seg_id, kind, target, case when b > a then a + cast(('0x' || left(md5('7|' || episode_index || '|' || seg_id || '|' || kind), 8)) as bigint) % (b - a)
    else b - 1 end as frame from win where b > a or kind = 'final_tail'""")
def random_sample(spark, d):
    return iv.random_window_samples(_windows(spark, d), "7")


@query("p_explode_segments", "select episode_index, seg_id as pos, seg_id, start_frame, end_frame, text, skill from s")
def exploded(spark, d):
    return iv.explode_segments(px.episodes(spark, d))


@query("p_half_open", "select episode_index, seg_id, start_frame, least(end_frame - 1 + 1, length) as end_frame from s join e using (episode_index)")
def half_open(spark, d):
    closed = px.segments(spark, d).join(px.episodes(spark, d).select("episode_index", "length"), "episode_index").withColumn("end_frame", F.col("end_frame") - 1)
    return iv.half_open(closed, F.col("length")).select("episode_index", "seg_id", "start_frame", "end_frame")


#: Segments with faults: of episodes that 3 divides the second starts a frame late, of those with rest 1 the last is cut short.
FAULTY = """, bad as (select episode_index, seg_id, start_frame + case when episode_index % 3 = 0 and seg_id = 1 then 1 else 0 end as start_frame,
    end_frame - case when episode_index % 3 = 1 and lead(seg_id) over (partition by episode_index order by seg_id) is null then 1 else 0 end as end_frame, text from s)
"""


def _faulty(spark, d):
    s, m = px.segments(spark, d), F.pmod("episode_index", F.lit(3))
    last = F.lead("seg_id").over(iv.of_episode()).isNull()
    return s.select(
        "episode_index", "seg_id", (F.col("start_frame") + F.when((m == 0) & (F.col("seg_id") == 1), 1).otherwise(0)).alias("start_frame"),
        (F.col("end_frame") - F.when((m == 1) & last, 1).otherwise(0)).alias("end_frame"), "text",
    )


@query("v_contiguity", FAULTY + """, v as (select *, start_frame <> coalesce(lag(end_frame) over (partition by episode_index order by seg_id), 0) as gap from bad),
o as (select episode_index, cast(sum(gap::int) as bigint) as gaps, cast(sum((end_frame <= start_frame)::int) as bigint) as empty, max(end_frame) as mx from v group by all)
select episode_index, gaps, empty, cast(mx <> length as bigint) as uncovered from e join o using (episode_index) where gaps + empty > 0 or mx <> length""")
def contiguity(spark, d):
    return iv.contiguity(_faulty(spark, d), px.episodes(spark, d))


@query("v_reflow", FAULTY + """select episode_index, seg_id, coalesce(lag(end_frame) over w, 0) as start_frame, end_frame, trim(text) as text,
    case when end_frame < 0 then 'negative' when end_frame <= coalesce(lag(end_frame) over w, 0) then 'not_increasing' else 'ok' end as code
    from bad window w as (partition by episode_index order by seg_id)""")
def reflow(spark, d):
    return iv.reflow(_faulty(spark, d))


@query("i_boundaries_to_segments", "select episode_index, seg_id, start_frame, end_frame from s")
def from_boundaries(spark, d):
    e = px.episodes(spark, d)
    inner = F.transform(F.filter("action_config", lambda x: x["end_frame"] < F.col("length")), lambda x: x["end_frame"])
    return iv.boundaries_to_segments(e.select("episode_index", "length", inner.alias("boundaries")))


#: Order lines as raw segments: an order is an episode, a line a segment of as many frames as its quantity, inclusive ends.
RAW = """with r as (select l_orderkey as episode_index, l_linenumber - 1 as pos, l_quantity, l_returnflag, l_linestatus,
    sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as hi,
    case l_returnflag when 'N' then 'keep' when 'R' then 'merge_prev' else 'drop' end as action,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as p from lineitem),
raw as (select episode_index, p as pos, cast(hi - l_quantity as bigint) as start_frame, cast(hi - 1 as bigint) as end_frame, action, l_linestatus as skill, cast(l_quantity as bigint) as q from r)
"""


def raw(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    t = px.table(spark, d, "lineitem")
    hi = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    action = F.when(F.col("l_returnflag") == "N", "keep").when(F.col("l_returnflag") == "R", "merge_prev").otherwise("drop")
    return t.select(
        F.col("l_orderkey").alias("episode_index"), (F.row_number().over(w) - 1).cast("long").alias("pos"), (hi - F.col("l_quantity")).cast("long").alias("start_frame"),
        (hi - 1).cast("long").alias("end_frame"), action.alias("action"), F.col("l_linestatus").alias("skill"), F.col("l_quantity").cast("long").alias("q"),
    )


@query("i_merge_prev", RAW + """, g as (select *, sum((action = 'keep')::int) over (partition by episode_index order by pos) as grp from raw)
select episode_index, cast(grp as bigint) as grp, arg_min(start_frame, pos) as start_frame, max(end_frame) as end_frame, count(*) as parts from g where grp > 0 and action <> 'drop' group by episode_index, grp""", views=False)
def merge_prev(spark, d):
    return iv.merge_prev(raw(spark, d))


@query("i_drawer_islands", RAW + """, g as (select *, case when skill = lag(skill) over (partition by episode_index order by start_frame, end_frame, pos) then 0 else 1 end as new from raw),
h as (select *, sum(new) over (partition by episode_index order by start_frame, end_frame, pos rows unbounded preceding) as island from g)
select episode_index, cast(island as bigint) as island, skill, min(start_frame) as start_frame, max(end_frame) as end_frame, count(*) as parts from h group by episode_index, island, skill""", views=False)
def islands(spark, d):
    return iv.islands(raw(spark, d), ["skill"])


@query("i_coverage_rebuild", RAW + """, fr as (select *, max(q) over (partition by episode_index) as frames from raw),
k as (select *, count(*) over (partition by episode_index) as n from fr where pos < frames),
z as (select episode_index, pos as seg_id, case when pos = n - 1 then frames - 1 else pos + least(frames - n, greatest(0, max(end_frame - pos) over (partition by episode_index order by pos))) end as end_frame from k)
select episode_index, seg_id, end_frame, coalesce(lag(end_frame) over (partition by episode_index order by seg_id), -1) + 1 as start_frame from z""", views=False)
def coverage(spark, d):
    from pyspark.sql import Window

    return iv.rebuild_coverage(raw(spark, d).withColumn("frames", F.max("q").over(Window.partitionBy("episode_index"))))


@query("i_edit_split", """, x as (select s.*, (length - 1) // 2 as mid from s join e using (episode_index)),
y as (select *, mid >= start_frame and mid < end_frame and end_frame - start_frame >= 2 as hit, least(greatest(mid, start_frame + 1), end_frame - 1) as cut from x),
o as (select episode_index, seg_id, text, 0 as part, case when hit then cut else end_frame end as ef from y union all select episode_index, seg_id, text, 1, end_frame from y where hit)
select episode_index, row_number() over w - 1 as seg_id, coalesce(lag(ef) over w, 0) as start_frame, ef as end_frame, text from o window w as (partition by episode_index order by seg_id, part)""")
def split(spark, d):
    e = px.episodes(spark, d)
    return iv.split_segments(px.segments(spark, d), e.select("episode_index", F.floor((F.col("length") - 1) / 2).alias("at")))


@query("i_edit_delete", """select episode_index, row_number() over w - 1 as seg_id, coalesce(lag(end_frame) over w, 0) as start_frame, end_frame, text from s where seg_id <> episode_index % 5
    window w as (partition by episode_index order by seg_id)""")
def delete(spark, d):
    return iv.delete_segments(px.segments(spark, d), F.col("seg_id") == F.pmod("episode_index", F.lit(5)))


@query("i_edit_move", """, x as (select *, lead(end_frame) over w as nx from s window w as (partition by episode_index order by seg_id)),
y as (select *, case when nx is null then end_frame else least(greatest(end_frame + 3, start_frame + 1), nx - 1) end as moved from x)
select episode_index, seg_id, coalesce(lag(moved) over (partition by episode_index order by seg_id), 0) as start_frame, moved as end_frame from y""")
def move(spark, d):
    return iv.move_boundaries(px.segments(spark, d), F.lit(3))


@query("v_chain_breaks", """, b as (select s.episode_index, seg_id, case when s.episode_index % 6 = 1 and seg_id = 1 then start_frame + 1 else start_frame end as start_frame, end_frame, lag(end_frame, 1, 0) over (partition by s.episode_index order by seg_id) as p from s where s.episode_index % 6 <> 2),
x as (select e.episode_index, e.length + (e.episode_index % 6 = 3)::int as length, min(seg_id) filter (where start_frame <> p) as bad, count(b.seg_id) as n, max(end_frame) as fin from e left join b on b.episode_index = e.episode_index group by all)
select episode_index, case when n = 0 then -1 when bad is not null then bad else n end as at from x where n = 0 or bad is not null or fin <> length""")
def chain_breaks(spark, d):
    m = F.pmod("episode_index", F.lit(6))
    s = px.segments(spark, d).filter(m != 2).withColumn("start_frame", F.when((m == 1) & (F.col("seg_id") == 1), F.col("start_frame") + 1).otherwise(F.col("start_frame")))
    return iv.chain_breaks(s, px.episodes(spark, d).select("episode_index", (F.col("length") + (m == 3).cast("long")).alias("length")))


@query("i_edit_mark_end", """, c as (select s.episode_index, seg_id, start_frame, end_frame, text from s where seg_id < 2), l as (select e.episode_index, e.length, e.length * 2 // 3 as mark, coalesce(max(end_frame), 0) as fin, count(seg_id) as n from e left join c using (episode_index) group by all)
select * from c union all select episode_index, n, fin, least(mark, length), '' from l where least(mark, length) > fin""")
def mark_end(spark, d):
    e = px.episodes(spark, d).select("episode_index", "length", F.floor(F.col("length") * 2 / 3).alias("at"))
    return iv.mark_end(px.segments(spark, d).filter("seg_id < 2"), e)


@query("i_edit_finish", """, c as (select s.episode_index, seg_id, start_frame, end_frame, text from s where seg_id < 3), l as (select e.episode_index, e.length, coalesce(max(end_frame), 0) as fin, count(seg_id) as n from e left join c using (episode_index) group by all)
select * from c union all select episode_index, n, fin, length, '' from l where length > fin""")
def finish(spark, d):
    return iv.finish_to_end(px.segments(spark, d).filter("seg_id < 3"), px.episodes(spark, d))


@query("i_nearest_boundary", ", c as (select *, lead(seg_id) over (partition by episode_index order by seg_id) is not null as more from s) select c.episode_index, arg_min(seg_id, (abs(end_frame - length // 2), seg_id)) as seg_id from c join e using (episode_index) where more group by c.episode_index")
def nearest_boundary(spark, d):
    return iv.nearest_boundary(px.segments(spark, d), px.episodes(spark, d).select("episode_index", F.floor(F.col("length") / 2).alias("at")))


@query("j_interval_inclusive", "select f.episode_index, frame_index, seg_id from f join s on f.episode_index = s.episode_index and frame_index between start_frame and end_frame - 1")
def inclusive(spark, d):
    s = px.segments(spark, d).withColumn("end_frame", F.col("end_frame") - 1)
    return scan_join(px.frames(spark, d).select("episode_index", "frame_index"), s, closed=True).select("episode_index", "frame_index", "seg_id")


@query("j_point_in_interval", """select f.episode_index, frame_index, coalesce(min(seg_id), any_value(ns)) as seg_id, coalesce(arg_min(text, seg_id), 'task_completed') as text
    from f left join (select * from s where seg_id <> 2) s2 on f.episode_index = s2.episode_index and frame_index >= start_frame and frame_index < end_frame
    join (select episode_index, count(*) as ns from s group by all) c on c.episode_index = f.episode_index group by f.episode_index, frame_index""")
def point(spark, d):
    s = px.segments(spark, d)
    n = s.groupBy("episode_index").agg(F.count(F.lit(1)).alias("ns"))
    one = scan_join(px.frames(spark, d).select("episode_index", "frame_index"), s.filter("seg_id <> 2"), first_by=["seg_id"], how="left")
    return one.join(n, "episode_index").select("episode_index", "frame_index", F.coalesce("seg_id", "ns").alias("seg_id"), F.coalesce("text", F.lit("task_completed")).alias("text"))


@query("j_interval_priority", WINDOWS + """, h as (select f.episode_index, frame_index, min(case kind when 'transition' then 0 when 'final_tail' then 1 when 'uniform' then 2 end) as o
    from f left join win w on f.episode_index = w.episode_index and frame_index >= lo and frame_index < hi group by all)
select episode_index, frame_index, coalesce(['transition', 'final_tail', 'uniform'][cast(o + 1 as int)], 'outside') as kind from h""")
def priority(spark, d):
    w = _windows(spark, d).withColumnsRenamed({"lo": "start_frame", "hi": "end_frame"}).select("episode_index", "start_frame", "end_frame", "kind")
    w = w.withColumn("o", F.when(F.col("kind") == "transition", 0).when(F.col("kind") == "final_tail", 1).when(F.col("kind") == "uniform", 2))
    held = scan_join(px.frames(spark, d).select("episode_index", "frame_index"), w, first_by=["o"], how="left")
    return held.select("episode_index", "frame_index", F.coalesce("kind", F.lit("outside")).alias("kind"))


@query("j_neighbors", """select episode_index, seg_id, coalesce(lag(text) over w, '') as before, case when lead(seg_id) over w is null then 'task_completed' else lead(text) over w end as after
    from s window w as (partition by episode_index order by seg_id)""")
def neighbors(spark, d):
    w = iv.of_episode()
    after = F.when(F.lead("seg_id").over(w).isNull(), "task_completed").otherwise(F.lead("text").over(w))
    return px.segments(spark, d).select("episode_index", "seg_id", F.coalesce(F.lag("text").over(w), F.lit("")).alias("before"), after.alias("after"))
