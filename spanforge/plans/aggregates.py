"""Queries on roll-ups and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.score import neighbor_relation
from spanforge.operators import evaluate as ev
from spanforge.operators import sequence as sq
from spanforge.operators import stats as st
from spanforge.plans.registry import query
from spanforge.sources import proxies as px

RATIO = "coalesce(sum({c}) filter (where not skipped) / nullif(count(*) filter (where not skipped), 0), 0.0)"


@query("a_kind_stats", """select sample_kind, count(*) as n, sum(subtask_score) as subtask_sum, sum(memory_score) as memory_sum, sum(total_score) as total_sum,
    count(*) filter (where subtask_score >= 5) as exact_subtask, count(*) filter (where memory_score >= 5) as exact_memory from j where not skipped group by sample_kind""")
def kind_stats(spark, d):
    return ev.kind_stats(px.judged(spark, d), "sample_kind")


@query("a_step_summary", f"""select count(*) as n, count(*) filter (where skipped) as skipped, count(*) filter (where not skipped) as evaluated,
    {", ".join(f"round({RATIO.format(c=c + '_score')}, 6) as {c}_avg" for c in ("subtask", "memory", "total"))},
    round(count(*) filter (where not skipped and subtask_score >= 5 and memory_score >= 5) / nullif(count(*) filter (where not skipped), 0)::double, 6) as exact_ratio from j""")
def step_summary(spark, d):
    return ev.step_summary(px.judged(spark, d))


@query("a_source_histogram", "select case when doc_id % 9 = 0 then '<missing>' else dataset end as source, count(*) as n from j group by all")
def source_histogram(spark, d):
    rows = px.judged(spark, d).withColumn("dataset", F.when(F.pmod("doc_id", F.lit(9)) == 0, F.when(F.pmod("doc_id", F.lit(2)) == 0, " ")).otherwise(F.col("dataset")))
    return ev.source_histogram(rows, "dataset")


@query("a_neighbor_failures", """, q as (select *, case when doc_id % 3 <> 0 then (doc_id % 7) / 7.0::double end as p, case when doc_id % 5 <> 0 then (doc_id % 4) / 4.0::double end as nx from j),
q1 as (select *, case when subtask_score >= 0.5 then 'not_needed' when p is null and nx is null then 'unknown' when greatest(coalesce(p, -1), coalesce(nx, -1)) < 0.5 then 'neither' when nx is null then 'previous_subtask'
    when p is null then 'next_subtask' when abs(p - nx) < 1e-6 then 'neither' when p > nx then 'previous_subtask' else 'next_subtask' end as relation from q)
select sample_kind, count(*) as analyzed, count(*) filter (where subtask_score < 0.5) as failed, """
       + ", ".join(f"count(*) filter (where subtask_score < 0.5 and relation = '{r}') as {r}" for r in ("unknown", "neither", "previous_subtask", "next_subtask"))
       + " from q1 where not skipped group by rollup (sample_kind)")
def neighbor_failures(spark, d):
    p, n = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.pmod("doc_id", F.lit(7)) / 7.0), F.when(F.pmod("doc_id", F.lit(5)) != 0, F.pmod("doc_id", F.lit(4)) / 4.0)
    return ev.neighbor_failures(px.judged(spark, d).withColumn("relation", neighbor_relation(F.col("subtask_score"), p, n)), 0.5)


CHAIN = """, m0 as (select *, case when not skip then nullif(trim(pred), '') end as said from st),
m as (select *, coalesce(last_value(said ignore nulls) over (partition by episode_index order by sample_id rows between unbounded preceding and 1 preceding), 'start') as memory_in from m0)
"""


@query("a_episode_summary", CHAIN + """select episode_index, count(*) as samples, string_agg(sample_id::varchar, ',' order by sample_id) as sample_ids, arg_min(memory_in, sample_id) as first_memory,
    arg_max(coalesce(said, memory_in), sample_id) as last_memory, count(case when not skip then length(role) end) as judged, round(avg(case when not skip then length(role) * 1.0::double end), 6) as score_avg from m group by episode_index""")
def episode_summary(spark, d):
    rows = sq.memory_chain(px.steps(spark, d), "start").withColumn("score", F.when(~F.col("skip"), F.length("role").cast("double")))
    return ev.episode_summary(rows)


@query("a_task_rollup", """, r as (select case when dataset = 'src3' then '<empty_task>' else task_text end as task, sum(case when not skipped then total_score else 0 end) as s, sum((not skipped)::int) as samples, doc_id from j group by all)
select task, count(*) as episodes, cast(sum(samples) as bigint) as samples, round(case when task is null and sum(samples) = 0 then null else sum(s) / greatest(sum(samples), 1) end, 6) as score_avg from r group by rollup (task)""")
def task_rollup(spark, d):
    live = ~F.col("skipped")
    rows = px.judged(spark, d).select("doc_id", F.when(F.col("dataset") == "src3", " ").otherwise(F.col("task_text")).alias("task_text"), live.cast("long").alias("samples"), F.when(live, F.col("total_score")).otherwise(0.0).alias("score_sum"))
    return ev.task_rollup(rows)


@query("a_template_groups", "select ns, count(*) as episodes, cast(sum(ns) as bigint) as segments from (select episode_index, count(*) as ns from s group by all) group by ns")
def template_groups(spark, d):
    e = px.episodes(spark, d).select(F.size("action_config").cast("long").alias("ns"))
    return e.groupBy("ns").agg(F.count(F.lit(1)).alias("episodes"), F.sum("ns").alias("segments"))


LONG = "with v as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings)"
FIT = ", fit as (select label, dim, avg(x) as mean, greatest(var_pop(x), 1e-4) as var from v group by label, dim)"


@query("a_gaussian_fit", LONG + FIT + " select label, dim, round(mean, 6) as mean, round(var, 6) as var from fit", views=False)
def gaussian_fit(spark, d):
    fit = st.gaussian_fit(px.table(spark, d, "embeddings"), "embedding", "label")
    return fit.select("label", "dim", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("a_zscore", LONG + ", p as (select dim, avg(x) as m, greatest(stddev_pop(x), 1e-4) as s from v group by dim) select vec_id, dim, round((x - m) / s, 6) as z from v join p using (dim)", views=False)
def zscore(spark, d):
    return st.zscores(px.table(spark, d, "embeddings"), "embedding", "vec_id").withColumn("z", F.round("z", 6))


@query("f_gaussian_cost", LONG + FIT + " select vec_id, fit.label as model, round(avg(0.5 * ((x - mean) * (x - mean) / var + ln(var))), 6) as cost from v join fit using (dim) group by vec_id, fit.label", views=False)
def gaussian_cost(spark, d):
    t = px.table(spark, d, "embeddings")
    fit = st.gaussian_fit(t, "embedding", "label").withColumnRenamed("label", "model")
    return st.gaussian_cost(t, "embedding", "vec_id", fit, "model").withColumn("cost", F.round("cost", 6))


#: The first vector of each label is its model; targets are all vectors, lengths follow from their numbers.
MODELS = ", md as (select label as model, arg_min(embedding, vec_id) as mv, min(vec_id) % 50 + 10 as mlength from embeddings group by label)"
DISTANCE = "sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::double - mv[i]) * (embedding[i]::double - mv[i]))) / len(embedding))"


def _models(spark, d):
    t = px.table(spark, d, "embeddings")
    models = t.groupBy(F.col("label").alias("model")).agg(F.min_by("embedding", "vec_id").alias("mv"), (F.pmod(F.min("vec_id"), F.lit(50)) + 10).alias("mlength"))
    return t.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.pmod("vec_id", F.lit(40)) + 10).alias("length")), models


@query("f_descriptor_distance", "with z as (select 1)" + MODELS + f" select vec_id as id, model, round({DISTANCE}, 6) as distance from embeddings, md", views=False)
def descriptor_distance(spark, d):
    t, m = _models(spark, d)
    return t.crossJoin(F.broadcast(m)).select("id", "model", F.round(st.descriptor_distance(F.col("v"), F.col("mv")), 6).alias("distance"))


@query("j_nearest_template", "with z as (select 1)" + MODELS + f", c as (select vec_id as id, model, {DISTANCE} + 0.5 * abs(ln((vec_id % 40 + 10) / mlength::double)) as score from embeddings, md) select id, arg_min(model, (score, model)) as model, round(min(score), 6) as score from c group by id", views=False)
def nearest(spark, d):
    return st.nearest(*_models(spark, d)).withColumn("score", F.round("score", 6))


@query("a_ratio_priors", """, x as (select s.*, count(*) over (partition by episode_index) as template, length::double as len from s join e using (episode_index))
select template, seg_id, round(median(start_frame / len), 6) as start, round(median((end_frame - start_frame) / len), 6) as part, round(min((end_frame - start_frame) / len), 6) as least from x group by template, seg_id""")
def ratio_priors(spark, d):
    p = st.ratio_priors(px.segments(spark, d), px.episodes(spark, d))
    return p.select("template", "seg_id", *[F.round(c, 6).alias(c) for c in ("start", "part", "least")])


@query("a_mode_nonempty", ", c as (select skill, phrase, count(*) as n, min(event_id) as first from ph where trim(phrase) <> '' group by all) select skill, arg_min(phrase, (-n, first)) as mode, max(n) as n from c group by skill")
def mode_nonempty(spark, d):
    return st.mode_nonempty(px.phrases(spark, d), "skill", "phrase", "event_id")


@query("a_descriptor", "select episode_index, round(ln(1 + count(*)), 6) as len, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(avg(k), 6) as kmean, round(stddev_pop(k), 6) as kstd from f group by episode_index")
def descriptor(spark, d):
    f = px.frames(spark, d)
    parts = {"len": F.ln(1 + F.count(F.lit(1))), "mean": F.avg("value"), "std": F.stddev_pop("value"), "kmean": F.avg("k"), "kstd": F.stddev_pop("k")}
    return f.groupBy("episode_index").agg(*[F.round(c, 6).alias(n) for n, c in parts.items()])


@query("a_robust01", """, p as (select episode_index, quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b from f group by all)
select f.episode_index, frame_index, round(least(1.0, greatest(0.0, (value - a) / greatest(b - a, 1e-6))), 6) as scaled from f join p on f.episode_index = p.episode_index""")
def robust01(spark, d):
    return st.robust01(px.frames(spark, d).select("episode_index", "frame_index", "value"), "value", "episode_index").select("episode_index", "frame_index", F.round("scaled", 6).alias("scaled"))


@query("a_normalize_cost", LONG + " , p as (select vec_id, quantile_cont(abs(x), 0.9) as q from v group by vec_id) select vec_id, dim, round(abs(x) / greatest(q, 1e-6), 6) as scaled from v join p using (vec_id)", views=False)
def normalize_cost(spark, d):
    long = st.by_dimension(px.table(spark, d, "embeddings"), "embedding", "vec_id").withColumn("x", F.abs("x"))
    return st.percentile_scale(long, "x", "vec_id").select("vec_id", "dim", F.round("scaled", 6).alias("scaled"))


@query("a_histogram10", ", b as (select event_type, cast(least(greatest(floor(k / 10.0::double), 0), 9) as bigint) as bin from f) select event_type, bin, round(count(*) / sum(count(*)) over (partition by event_type)::double, 6) as part from b group by event_type, bin")
def histogram10(spark, d):
    return st.histogram(px.frames(spark, d), "k", 0.0, 100.0, 10, "event_type").withColumn("part", F.round("part", 6))
