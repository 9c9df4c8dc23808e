"""Queries that run as streams: rows arrive in a folder in order of time, a stream takes them trigger by trigger, its sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import requests as rq
from spanforge.plans.registry import query
from spanforge.sinks.ledger import Ledger, exactly_once
from spanforge.sinks.writers import scratch
from spanforge.sources import proxies as px
from spanforge.sources import requests as rs
from spanforge.streaming import runs, traces, windows

IDLE_MS = 600_500


def _said(spark, d):
    """Conversations as sessions whose steps lie further and further apart."""
    c = px.table(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + 61 * F.col("conv_id") + 60 * F.col("turn") * F.col("turn"))
    return c.select(F.col("conv_id").alias("session"), at.alias("ts"), F.col("turn").alias("sample_id"), F.when(F.col("role") == "assistant", F.col("text")).alias("pred"), (F.col("role") == "system").alias("skip"))


SAID = """with r as (select conv_id as session, turn as sample_id, 1700000000 + 61 * conv_id + 60 * turn * turn as tm, case when role = 'assistant' and trim(text) <> '' then trim(text) end as said from conversations),
o as (select *, coalesce(tm - lag(tm) over w > 600, true) as opens from r window w as (partition by session order by tm)),
t as (select *, max(case when opens then tm end) over (partition by session order by tm) as started from o),
m as (select *, row_number() over w as step_id, coalesce(last_value(said ignore nulls) over (partition by session, started order by tm rows between unbounded preceding and 1 preceding), 'start') as memory_in from t
    window w as (partition by session, started order by tm)),
x as (select *, coalesce(said, memory_in) as memory_out from m)
"""


@query("t_session_trace", SAID + """select session, 'step' as kind, sample_id, step_id, memory_in, memory_out, started, null as samples from x
union all select session, 'closed', null, count(*), null, arg_max(memory_out, tm), started, string_agg(sample_id::varchar, ',' order by tm) from x group by session, started
    having max(tm) + 600.5 < (select max(tm) - ((max(tm) - min(tm)) // 4 + 2) from r) or started < (select max(started) from x y where y.session = x.session)""", views=False)
def session_trace(spark, d):
    rows, path, ledger = _said(spark, d), scratch(spark, "trace-in"), Ledger(scratch(spark, "trace"))
    late = runs.stretch(rows, F.col("ts"))
    found = traces.follow(runs.arrive(rows, path, "ts", "session"), "start", IDLE_MS, f"{late} seconds")
    runs.finish(found.writeStream.foreachBatch(lambda b, i: ledger.write(b, i)), scratch(spark, "trace-check"), rocks=True)
    back = ledger.read(spark, f"session long, {traces.COLUMNS}")
    return back.withColumn("started", F.unix_seconds("started"))


@query("t_exactly_once", "select distinct conv_id, turn, role, text from conversations", views=False)
def once(spark, d):
    c = px.table(spark, d, "conversations").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 61 * F.col("conv_id") + F.col("turn")))
    ledger = Ledger(scratch(spark, "once"))
    late = runs.stretch(c, F.col("ts"))
    stream = exactly_once(runs.arrive(c, scratch(spark, "once-in"), "ts", "conv_id", again=lambda i: i % 2 == 0), ["conv_id", "turn", "role", "text"], "ts", f"{2 * late} seconds")

    def twice(batch, number):  # as when a trigger is run again after a failure
        ledger.write(batch, number)
        ledger.write(batch, number)

    runs.finish(stream.select("conv_id", "turn", "role", "text").writeStream.foreachBatch(twice), scratch(spark, "once-check"))
    return ledger.read(spark, "conv_id long, turn long, role string, text string")


def _events(spark, d):
    e = px.table(spark, d, "events")
    return e.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def _closed(spark, rows, make, name):
    """The windows that a stream over rows closes."""
    late, out = runs.stretch(rows, F.col("ts")), scratch(spark, name)
    found = make(runs.arrive(rows, scratch(spark, f"{name}-in"), "ts", "event_id"), f"{late} seconds")
    runs.finish(found.writeStream.format("parquet").option("path", out).outputMode("append"), scratch(spark, f"{name}-check"))
    back = spark.read.schema(found.schema).parquet(out)
    return back.withColumns({"start": F.unix_micros("start"), "end": F.unix_micros("end"), "value": F.round("value", 4)})


UNTIL = "(select max(epoch_us(ts)) - 1000000 * ((epoch_ms(max(ts)) - epoch_ms(min(ts))) // 4000 + 2) from events)"


@query("t_session_windows", f"""with o as (select user_id, epoch_us(ts) as tm, value, event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 21600000000, true) as opens from events),
g as (select *, sum(opens::int) over (partition by user_id order by tm, event_id) as part from o)
select user_id, min(tm) as start, max(tm) + 21600000000 as end, count(*) as n, round(sum(value), 4) as value from g group by user_id, part having max(tm) + 21600000000 <= {UNTIL}""", views=False)
def session_windows(spark, d):
    return _closed(spark, _events(spark, d), lambda s, late: windows.sessions(s, ["user_id"], "6 hours", late=late), "sessions")


@query("t_sliding_windows", f"""with s as (select event_type, unnest(range(epoch_us(ts) // 21600000000 - 3, epoch_us(ts) // 21600000000 + 1)) * 21600000000 as start, value from events)
select event_type, start, start + 86400000000 as end, count(*) as n, round(sum(value), 4) as value from s group by event_type, start having start + 86400000000 <= {UNTIL}""", views=False)
def sliding_windows(spark, d):
    return _closed(spark, _events(spark, d), lambda s, late: windows.sliding(s, ["event_type"], "24 hours", "6 hours", late=late), "sliding")


@query("s_recorded_requests", """select conv_id || '-' || turn as request_id, case when role = 'system' then 'ping' when role = 'user' then 'inference_result' else 'unknown' end as type,
    case when role = 'assistant' then 'error' else 'ok' end as status, case when role = 'user' then text end as said, case when role = 'assistant' then 'Unsupported message type ''recall''' end as error from conversations""", views=False)
def recorded_requests(spark, d):
    c = px.table(spark, d, "conversations")
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    request = F.concat_ws("-", "conv_id", "turn")
    kind = F.when(F.col("role") == "system", "ping").when(F.col("role") == "user", "infer").otherwise("recall")
    payload = F.struct(request.alias("request_id"), answer.alias("response"))
    lines = c.select("turn", F.to_json(F.struct(kind.alias("type"), request.alias("request_id"), payload.alias("payload"))).alias("value"))
    path, out, check = (scratch(spark, f"requests{x}") for x in ("", "-out", "-check"))
    for part in ("turn < 2", "turn >= 2"):  # the second run goes on where the first has stopped
        lines.filter(part).select("value").write.mode("append").text(path)
        got = rs.stream_requests(spark, path).select(rq.routed(F.col("message")).alias("r"))
        said = rq.chat_text(F.get_json_object("r.payload", "$.response"))["text"]
        answered = got.select("r.request_id", "r.type", "r.status", said.alias("said"), "r.error")
        runs.finish(answered.writeStream.format("parquet").option("path", out), check)
    return spark.read.schema(answered.schema).parquet(out)
