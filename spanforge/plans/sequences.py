"""Queries on ordered frames, the segment solver and session state."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import score as sc
from spanforge.operators import segment as sg
from spanforge.operators import sequence as sq
from spanforge.operators.ordering import share
from spanforge.plans.aggregates import CHAIN
from spanforge.plans.registry import query
from spanforge.sources import proxies as px
from spanforge.streaming import sessions as ss

BY = "window w as (partition by episode_index order by frame_index)"


def _f(spark, d):
    return px.frames(spark, d).select("episode_index", "frame_index", "value", "k", "ts")


@query("w_diff", f", x as (select *, coalesce(value - lag(value) over w, 0) as d1 from f {BY}) select episode_index, frame_index, round(d1, 6) as d1, round(coalesce(d1 - lag(d1) over w, 0), 6) as d2 from x {BY}")
def diff(spark, d):
    d1, d2 = sq.differences()
    return _f(spark, d).select("episode_index", "frame_index", F.round(d1, 6).alias("d1"), F.round(d2, 6).alias("d2"))


@query("w_moving_avg", f""", x as (select episode_index, frame_index, sum(value) over (partition by episode_index order by frame_index rows between 8 preceding and 8 following) as s, first_value(value) over (partition by episode_index order by frame_index) as a,
    last_value(value) over (partition by episode_index order by frame_index rows between unbounded preceding and unbounded following) as b, count(*) over (partition by episode_index) as n from f)
select episode_index, frame_index, round((s + greatest(0, 8 - frame_index) * a + greatest(0, frame_index + 8 - (n - 1)) * b) / 17, 6) as avg from x""")
def moving_avg(spark, d):
    return _f(spark, d).select("episode_index", "frame_index", F.round(sq.moving_average(), 6).alias("avg"))


@query("w_temporal_context", """select episode_index, frame_index, coalesce(lag(value, 2) over w, first_value(value) over w) as m2, coalesce(lag(value, 1) over w, first_value(value) over w) as m1, value as z,
    coalesce(lead(value, 1) over w, last_value(value) over (partition by episode_index order by frame_index rows between unbounded preceding and unbounded following)) as p1,
    coalesce(lead(value, 2) over w, last_value(value) over (partition by episode_index order by frame_index rows between unbounded preceding and unbounded following)) as p2 from f """ + BY)
def context(spark, d):
    cols = sq.temporal_context("value", (-2, -1, 0, 1, 2))
    return _f(spark, d).select("episode_index", "frame_index", *[c.alias(n) for c, n in zip(cols, ("m2", "m1", "z", "p1", "p2"), strict=True)])


@query("w_local_minima", f", x as (select *, lag(value) over w as p, lead(value) over w as n, count(*) over (partition by episode_index) as len from f {BY}) select episode_index, frame_index, value from x where value <= p and value <= n and frame_index > 1 and frame_index < len - 2")
def minima(spark, d):
    from pyspark.sql import Window

    rows = _f(spark, d).withColumn("len", F.count(F.lit(1)).over(Window.partitionBy("episode_index")))
    return sq.local_minima(rows, "value", 1, F.col("len") - 2).select("episode_index", "frame_index", "value")


@query("w_prefix_sum", f"select episode_index, frame_index, round(sum(value) over (partition by episode_index order by frame_index rows unbounded preceding), 4) as total from f")
def prefix(spark, d):
    return _f(spark, d).select("episode_index", "frame_index", F.round(sq.prefix_sum("value"), 4).alias("total"))


@query("w_stride_cap", """, x as (select episode_index, length, cast(greatest(1, ceil(length / 16.0::double)) as bigint) as step from e)
select episode_index, step, round(30.0::double / step, 6) as fps, unnest(range(0, length, step)[1:16]) as frame_index from x""")
def stride(spark, d):
    return sq.stride_cap(px.episodes(spark, d).select("episode_index", "length"), 16, 30.0).withColumn("fps", F.round("fps", 6))


@query("w_interval_sample", f", x as (select *, lead(frame_index) over w is null as last from f {BY}) select episode_index, frame_index from x where (frame_index >= 2 and (frame_index - 2) % 5 = 0) or last")
def interval(spark, d):
    return sq.interval_sample(_f(spark, d), 5, 2).select("episode_index", "frame_index")


@query("w_greedy_gap", "select episode_index, unnest(list_reduce(list(struct_pack(i := frame_index, t := epoch_us(ts)) order by frame_index), lambda a, x: case when x.t - a.last >= 86400000000 then struct_pack(last := x.t, taken := list_append(a.taken, x.i)) else a end, struct_pack(last := -9000000000000000::bigint, taken := []::bigint[])).taken) as frame_index from f group by episode_index")
def greedy(spark, d):
    return sq.greedy_gap(_f(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), "t", 86400.0)


@query("w_memory_chain", CHAIN + "select episode_index, sample_id, memory_in, coalesce(said, memory_in) as memory_out from m")
def memory(spark, d):
    return sq.memory_chain(px.steps(spark, d), "start").select("episode_index", "sample_id", "memory_in", "memory_out")


@query("w_round_robin", "select episode_index, frame_index, frame_index % 3 as worker from f")
def robin(spark, d):
    return sq.round_robin(_f(spark, d), 3).select("episode_index", "frame_index", "worker")


@query("w_global_share", "select event_id, (row_number() over (order by ts, event_id) - 1) % 7 as worker from events", views=False)
def global_share(spark, d):
    e = px.table(spark, d, "events").select("event_id", "ts")
    return share(e, [F.col("ts"), F.col("event_id")], 7).select("event_id", "worker")


@query("w_step_id", "select event_id, frame_index + 1 as step_id from f")
def step_id(spark, d):
    return px.frames(spark, d).select("event_id", (F.col("frame_index") + 1).alias("step_id"))


@query("w_boundary_conf", """, x as (select episode_index, frame_index, value, quantile_cont(value, 0.8) over v as p80, min(value) over v as low from f window v as (partition by episode_index order by frame_index rows between 10 preceding and 10 following))
select episode_index, frame_index, round(p80, 6) as p80, low, round(least(1.0, greatest(0.0, (p80 - value) / greatest(p80 - low, 1e-6))), 6) as pause from x""")
def confidence(spark, d):
    rows = sq.boundary_confidence(_f(spark, d), "value", 10)
    return rows.select("episode_index", "frame_index", F.round("p80", 6).alias("p80"), "low", F.round("pause", 6).alias("pause"))


def _labelled(spark, d):
    """(samples, motion, labelled segments, episodes): every third episode is labelled, of the others every second frame is a sample."""
    f = _f(spark, d)
    samples = f.filter("frame_index % 2 = 0").select("episode_index", "frame_index", F.array("value", F.col("k").cast("double")).alias("state"), F.array(F.pmod("k", F.lit(7)).cast("double")).alias("visual"))
    e = px.episodes(spark, d).select("episode_index", "length", F.array("task").alias("tasks"))
    return samples, f.select("episode_index", "frame_index", F.col("value").alias("motion")), px.segments(spark, d).filter("episode_index % 3 = 0"), e


#: For episodes of tens of frames.
SHORT = sg.Search(least=2, reach=(0.55, 5, 20), refine=3, keep=6, near=9)


@query("m_dp_segment")
def dp(spark, d):
    docs, summary = sg.annotate(*_labelled(spark, d), SHORT)
    return summary.select("episode_index", "num_subtasks", "matched_manual_episode", F.round("template_match_score", 6).alias("score"), "mean_confidence", F.array_join(F.transform("boundaries", lambda x: x.cast("string")), ",").alias("boundaries"), "error")


#: The labelled episodes' samples as SQL, number by number.
SAMPLED = """, sm as (select episode_index, frame_index, value::double as value, k::double as k, (k % 7)::double as v from f where frame_index % 2 = 0),
x as (select episode_index, frame_index, 'state' as modality, 0 as dim, value as x from sm union all select episode_index, frame_index, 'state', 1, k from sm union all select episode_index, frame_index, 'visual', 0, v from sm),
tm as (select episode_index, count(*) as template from s where episode_index % 3 = 0 group by all)"""


@query("m_assignment", SAMPLED + """, fl as (select episode_index, max(frame_index) + 1 as length from f group by all),
de as (select episode_index, case when modality = 'state' then 0 else 2 end + p as part, dim, case when p = 0 then m else d end as x from (select episode_index, modality, dim, avg(x) as m, stddev_pop(x) as d from x group by all), (values (0), (1)) v(p)
    union all select episode_index, -1, 0, ln(1 + length) from fl),
sd as (select part, dim, avg(x) as m, greatest(stddev_pop(x), 1e-4) as s from de group by all),
z as (select episode_index, part, dim, (x - m) / s as z from de join sd using (part, dim)),
di as (select a.episode_index, b.episode_index as matched, sqrt(sum((a.z - b.z) * (a.z - b.z)) / count(*)) as d from z a join z b using (part, dim) where a.episode_index % 3 <> 0 and b.episode_index % 3 = 0 group by all),
sc as (select di.episode_index, matched, d + 2.0::double * abs(ln(l.length::double / m.length)) as score from di join fl l on l.episode_index = di.episode_index join fl m on m.episode_index = matched),
be as (select episode_index, arg_min(matched, (score, matched)) as matched, min(score) as score from sc group by episode_index)
select be.episode_index, matched, template, round(score, 6) as score from be join tm on tm.episode_index = matched""")
def assignment(spark, d):
    from spanforge.operators.features import last_frames

    samples, motion, segments, _ = _labelled(spark, d)
    return sg.match_templates(samples, last_frames(motion), segments, SHORT).withColumn("score", F.round("score", 6))


@query("m_models", SAMPLED + """, g as (select s.*, template from s join tm using (episode_index)),
h as (select g.episode_index, seg_id, template, frame_index from g join sm using (episode_index) where frame_index >= start_frame and frame_index < end_frame),
mi as (select g.episode_index, seg_id, template, arg_min(frame_index, (abs(frame_index - (start_frame + end_frame) // 2), frame_index)) as frame_index from g join sm using (episode_index) group by all),
n as (select episode_index, seg_id, count(*) as n from h group by all),
he as (select * from h union select mi.* from mi left join n on n.episode_index = mi.episode_index and n.seg_id = mi.seg_id where coalesce(n, 0) < 2),
w as (select template, modality, dim, avg(x) as all_mean, greatest(stddev_pop(x), 1e-4) as all_std from x join tm using (episode_index) group by all),
o as (select template, modality, seg_id, dim, avg(x) as m, var_pop(x) as v from he join x using (episode_index, frame_index) group by all)
select template, modality, seg_id, dim, round((m - all_mean) / all_std, 5) as mean, round(greatest(v / (all_std * all_std), 1e-4), 5) as var from o join w using (template, modality, dim)""")
def models(spark, d):
    samples, _, segments, episodes = _labelled(spark, d)
    known = samples.join(segments.select("episode_index").distinct(), "episode_index", "left_semi")
    return sg.fit_models(known, segments, episodes).select("template", "modality", "seg_id", "dim", F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var"))


@query("m_documents")
def dp_documents(spark, d):
    docs, _ = sg.annotate(*_labelled(spark, d), SHORT)
    return docs.select("episode_index", "length", F.array_join("tasks", "|").alias("tasks"), F.to_json("action_config").alias("action_config"))


@query("f_segment_window", "select episode_index, seg_id, cast(trunc(least(460, greatest(65, 0.55::double * greatest(end_frame - start_frame, coalesce(lead(end_frame - start_frame) over w, 0)) * 30))) as bigint) as reach, "
       "case when 0.55::double * greatest(end_frame - start_frame, coalesce(lead(end_frame - start_frame) over w, 0)) * 30 > 460 then 'most' else 'less' end as side from s window w as (partition by episode_index order by seg_id)")  # fmt: skip
def segment_window(spark, d):
    from spanforge.operators.intervals import of_episode

    n = F.col("end_frame") - F.col("start_frame")
    longest = F.greatest(n, F.coalesce(F.lead(n).over(of_episode()), F.lit(0))) * 30
    s = px.segments(spark, d).select("episode_index", "seg_id", sc.candidate_reach(longest).alias("reach"), F.when(0.55 * longest > 460, "most").otherwise("less").alias("side"))
    return s


@query("f_boundary_confidence", """, x as (select episode_index, frame_index, value, quantile_cont(value, 0.8) over v as p80, min(value) over v as low, (k - 50) as off from f window v as (partition by episode_index order by frame_index rows between 10 preceding and 10 following))
select episode_index, frame_index, round_even(least(1.0::double, greatest(0.0::double, 0.55::double * (p80 - value) / greatest(p80 - low, 1e-6) + 0.45::double * exp(-abs(off) / 80.0::double))), 4) as confidence from x""")
def boundary_confidence(spark, d):
    rows = sq.boundary_confidence(_f(spark, d), "value", 10)
    raw = (F.col("p80") - F.col("value")) / F.greatest(F.col("p80") - F.col("low"), F.lit(1e-6))
    return rows.select("episode_index", "frame_index", sc.boundary_confidence(raw, F.col("k") - 50, F.lit(80.0)).alias("confidence"))


@query("f_combined_cost", "select event_id, round(0.45::double * value + 0.55::double * k, 6) as cost from f")
def combined_cost(spark, d):
    return px.frames(spark, d).select("event_id", F.round(sc.combine(F.col("value"), F.col("k")), 6).alias("cost"))


#: Mean cost of the sampled frames (every third) in each segment, or of the next one from its middle on.
@query("f_segment_cost", f""", x as (select episode_index, frame_index, value, row_number() over w - 1 as i, sum(value) over (partition by episode_index order by frame_index) as p from f where frame_index % 3 = 0 {BY}),
m as (select episode_index, count(*) as m from x group by all),
c as (select s.*, (select count(*) from x where x.episode_index = s.episode_index and frame_index < start_frame) as a, (select count(*) from x where x.episode_index = s.episode_index and frame_index < end_frame) as b,
    least((select count(*) from x where x.episode_index = s.episode_index and frame_index < (start_frame + end_frame) // 2), m - 1) as mid from s join m using (episode_index)),
c1 as (select *, case when b <= a then mid else a end as lo, case when b <= a then mid + 1 else b end as hi from c)
select c1.episode_index, seg_id, round((u.p - coalesce(l.p, 0)) / (hi - lo), 4) as cost from c1 join x u on u.episode_index = c1.episode_index and u.i = hi - 1 left join x l on l.episode_index = c1.episode_index and l.i = lo - 1""")
def segment_cost(spark, d):
    rows = _f(spark, d).filter("frame_index % 3 = 0")
    return sq.interval_means(rows, "value", px.segments(spark, d)).select("episode_index", "seg_id", F.round("mean", 4).alias("cost"))


@query("w_vector_motion", f", x as (select *, value - lag(value) over w as a, k - lag(k) over w as b from f {BY}) select episode_index, frame_index, round(coalesce(a, 0), 6) as d0, round(sqrt(coalesce(a, 0) * coalesce(a, 0) + coalesce(b, 0) * coalesce(b, 0)), 6) as motion from x")
def vector_motion(spark, d):
    rows = _f(spark, d).withColumn("v", F.array("value", F.col("k").cast("double")))
    delta, size = sq.vector_difference("v")
    return rows.select("episode_index", "frame_index", F.round(delta[0], 6).alias("d0"), F.round(size, 6).alias("motion"))


@query("a_state_features", f""", x as (select episode_index, frame_index, value, coalesce(value - lag(value) over w, 0) as d1 from f {BY}), y as (select *, coalesce(d1 - lag(d1) over w, 0) as d2 from x {BY}),
z as (select *, sum(abs(d1)) over (partition by episode_index order by frame_index rows between 8 preceding and 8 following) as t, first_value(abs(d1)) over (partition by episode_index order by frame_index) as a,
    last_value(abs(d1)) over (partition by episode_index order by frame_index rows between unbounded preceding and unbounded following) as b, count(*) over (partition by episode_index) as n,
    coalesce(lag(d2, 5) over w, first_value(d2) over w) as before, coalesce(lead(value, 5) over w, last_value(value) over (partition by episode_index order by frame_index rows between unbounded preceding and unbounded following)) as after from y {BY})
select episode_index, frame_index, 21 as size, round(before, 6) as before, round(after, 6) as after, round((t + greatest(0, 8 - frame_index) * a + greatest(0, frame_index + 8 - (n - 1)) * b) / 17, 6) as motion from z""")
def state_features(spark, d):
    from spanforge.operators.features import state_features

    f = state_features(_f(spark, d), ["missing", "value"])
    return f.select("episode_index", "frame_index", F.size("state").cast("long").alias("size"), F.round(F.col("state")[8], 6).alias("before"), F.round(F.col("state")[12], 6).alias("after"), F.round("state_motion", 6).alias("motion"))


@query("a_episode_descriptors", """, x as (select episode_index, avg(value) as m1, stddev_pop(value) as s1, avg(k) as m2, stddev_pop(k) as s2, count(*) as n from f group by all), y as (select *, ln(1 + n) as l from x)
select episode_index, round((l - avg(l) over ()) / greatest(stddev_pop(l) over (), 1e-4), 5) as l, round((m1 - avg(m1) over ()) / greatest(stddev_pop(m1) over (), 1e-4), 5) as m1, round((s1 - avg(s1) over ()) / greatest(stddev_pop(s1) over (), 1e-4), 5) as s1,
    round((m2 - avg(m2) over ()) / greatest(stddev_pop(m2) over (), 1e-4), 5) as m2, round((s2 - avg(s2) over ()) / greatest(stddev_pop(s2) over (), 1e-4), 5) as s2 from y""")
def episode_descriptors(spark, d):
    from spanforge.operators import features as ft

    f = _f(spark, d)
    samples = f.select("episode_index", "frame_index", F.array("value").alias("state"), F.array(F.col("k").cast("double")).alias("visual"))
    v = ft.standardised(ft.descriptors(samples, ft.last_frames(f)), "v")
    return v.select("episode_index", *[F.round(F.col("v")[i], 5).alias(c) for i, c in enumerate(("l", "m1", "s1", "m2", "s2"))])


@query("w_whole_frames", """, c as (select episode_index, frame_index, event_type as camera from f where event_type in ('view', 'click')), l as (select episode_index, max(frame_index) as last from c group by episode_index, camera),
m as (select episode_index, min(last) as last from l group by episode_index having count(*) = 2) select episode_index, frame_index, camera from c join m using (episode_index) where frame_index <= last""")
def whole_frames(spark, d):
    from spanforge.operators.features import whole_frames

    return whole_frames(px.frames(spark, d).select("episode_index", "frame_index", F.col("event_type").alias("camera")), ["view", "click"]).select("episode_index", "frame_index", "camera")


@query("a_combined_motion", """, p as (select episode_index, quantile_cont(value, [0.05, 0.95]) as a, quantile_cont(k, [0.05, 0.95]) as b from f group by all)
select episode_index, frame_index, round(0.45::double * least(1, greatest(0, (value - a[1]) / greatest(a[2] - a[1], 1e-6))) + 0.55::double * least(1, greatest(0, (k - b[1]) / greatest(b[2] - b[1], 1e-6))), 6) as motion from f join p using (episode_index)""")
def combined_motion(spark, d):
    from spanforge.operators.features import combine_motion

    f = _f(spark, d)
    m = combine_motion(f.withColumnRenamed("value", "state_motion"), f.withColumn("visual_motion", F.col("k").cast("double")))
    return m.select("episode_index", "frame_index", F.round("motion", 6).alias("motion"))


@query("t_session_state", CHAIN + "select episode_index, sample_id, memory_in, coalesce(said, memory_in) as memory_out from m")
def session(spark, d):
    return ss.replay(px.steps(spark, d), "start")
