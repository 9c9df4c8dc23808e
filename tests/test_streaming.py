"""Streams against the same rows in batch: traces of sessions, exactly-once sinks, late rows, replayed requests."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "session string, ts timestamp, sample_id long, pred string, skip boolean, reset_memory boolean"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.01)  # files are taken in order of the time they were written at


def traced(spark, tmp_path, *appends, late="0 seconds", idle=600_000, **more):
    from spanforge.streaming import runs, traces

    for rows in appends:
        put(spark, rows, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = runs.finish(traces.follow(stream, "start", idle, late, **more).writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/check", rocks=True)
    return q, spark.read.parquet(f"{tmp_path}/out").collect()


def test_traces_close_when_idle_and_start_anew(spark, tmp_path):
    first = [("a", at(0), 1, "one", False, False), ("a", at(1), 2, " ", False, False), ("b", at(1), 1, "x", True, False)]
    other = [("c", at(30), 1, "far", False, False)]  # time goes on: a and b have fallen idle
    again = [("a", at(31), 1, "new", False, False), ("a", at(32), 2, None, False, True), ("c", at(45), 2, "late enough", False, False)]  # c's own gap closes its trace
    _, got = traced(spark, tmp_path, first, other, again)
    steps = {(r["session"], r["started"], r["sample_id"]): (r["step_id"], r["memory_in"], r["memory_out"]) for r in got if r["kind"] == "step"}
    starts = sorted({(k[0], k[1]) for k in steps})
    assert [s for s, _ in starts] == ["a", "a", "b", "c", "c"]
    a1, a2, b, c1, c2 = (t for _, t in starts)
    assert steps == {
        ("a", a1, 1): (1, "start", "one"), ("a", a1, 2): (2, "one", "one"), ("b", b, 1): (1, "start", "start"), ("a", a2, 1): (1, "start", "new"), ("a", a2, 2): (2, "start", "start"),
        ("c", c1, 1): (1, "start", "far"), ("c", c2, 2): (1, "start", "late enough"),
    }
    closed = {(r["session"], r["started"]): (r["step_id"], r["memory_out"], r["samples"]) for r in got if r["kind"] == "closed"}
    assert closed == {("a", a1): (2, "one", "1,2"), ("b", b): (1, "start", "1"), ("c", c1): (1, "far", "1"), ("a", a2): (2, "start", "1,2")}


def test_late_and_repeated_steps_are_marked(spark, tmp_path):
    _, got = traced(spark, tmp_path, [("a", at(0), 1, "one", False, False), ("a", at(2), 3, "three", False, False)], [("a", at(3), 3, "again", False, False), ("a", at(4), 2, "two", False, False), ("a", at(5), 4, "", False, False)])
    assert sorted((r["kind"], r["sample_id"], r["memory_in"], r["memory_out"]) for r in got if r["kind"] != "late") == [("step", 1, "start", "one"), ("step", 3, "one", "three"), ("step", 4, "three", "three")]
    assert sorted(r["sample_id"] for r in got if r["kind"] == "late") == [2, 3]


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    from spanforge.streaming import runs

    first, second = [("a", at(60), 1, "one", False, False)], [("a", at(61), 2, "", False, False)]  # a watermark holds from the trigger after next on
    q, got = traced(spark, tmp_path, first, second, [("b", at(0), 1, "too late", False, False), ("a", at(62), 3, "two", False, False)])
    assert runs.too_late(q) == 1 and {r["session"] for r in got} == {"a"}


def test_traces_by_the_clock(spark, tmp_path):
    """Without event time sessions fall idle by the clock; their state may also have a limit of its own."""
    from spanforge.streaming import runs, traces

    put(spark, [("a", at(0), 1, "one", False, False)], f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    found = traces.follow(stream, "start", 1500, None, keep_ms=60_000)
    writer = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="300 milliseconds")
    before = spark.conf.get(runs.STORE, None)
    spark.conf.set(runs.STORE, runs.ROCKS)
    q = writer.start()
    spark.conf.unset(runs.STORE) if before is None else spark.conf.set(runs.STORE, before)

    def until(n):
        for _ in range(60):
            time.sleep(0.5)
            there = (tmp_path / "out" / "_spark_metadata").exists()
            rows = [(r["kind"], r["sample_id"], r["memory_in"], r["samples"]) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()] if there else []
            if len(rows) >= n:
                break
        return sorted(rows, key=str)

    try:
        one = [("closed", None, None, "1"), ("step", 1, "start", None)]
        assert until(2) == one
        put(spark, [("a", at(1), 1, "anew", False, False)], f"{tmp_path}/in")
        assert until(4) == sorted(2 * one, key=str)
    finally:
        q.stop()


def test_stream_is_batch(spark, tmp_path):
    from spanforge.plans.streams import _said
    from spanforge.streaming import runs, traces

    rows = _said(spark, "/root/testdata/sf0.001").withColumn("reset_memory", F.col("sample_id") == 3)
    late = runs.stretch(rows, F.col("ts"))
    until = rows.agg(F.max(F.unix_millis("ts"))).first()[0] - 1000 * late
    stream = runs.arrive(rows, f"{tmp_path}/in", "ts", "session", files=2)
    runs.finish(traces.follow(stream, "start", 600_500, f"{late} seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/check", rocks=True)
    got, wanted = spark.read.parquet(f"{tmp_path}/out"), traces.replay(rows, "start", 600_500, until)
    assert got.exceptAll(wanted.select(got.columns)).count() == 0 == wanted.select(got.columns).exceptAll(got).count() and got.filter("kind = 'closed'").count() > 3


def test_ledger_after_a_failure(spark, tmp_path):
    """A batch that failed half-way is written anew, one that is entered isn't; what isn't entered isn't read."""
    from spanforge.sinks.ledger import Ledger

    ledger, rows = Ledger(f"{tmp_path}/sink"), spark.range(10)
    assert ledger.read(spark, "id long").count() == 0
    rows.write.parquet(f"{tmp_path}/sink/data/batch=0")  # written, but the attempt ended before its entry
    assert ledger.read(spark, "id long").count() == 0
    assert ledger.write(rows.filter("id < 4"), 0) and not ledger.write(rows, 0) and ledger.write(rows, 1)
    assert sorted(r["id"] for r in ledger.read(spark, "id long").collect()) == sorted([*range(4), *range(10)])


def test_late_rows_miss_their_window(spark, tmp_path):
    from spanforge.streaming import runs, windows

    schema = "k string, ts timestamp, value double"
    for rows in ([("a", at(0), 1.0), ("a", at(20), 1.0)], [("a", at(120), 2.0)], [("c", at(122), 0.0)], [("a", at(10), 4.0), ("a", at(121), 8.0)], [("b", at(500), 1.0)]):
        put(spark, rows, f"{tmp_path}/in", schema)
    made = {
        "tumbling": lambda s: windows.tumbling(s, ["k"], "1 hour"), "sliding": lambda s: windows.sliding(s, ["k"], "1 hour", "30 minutes"),
        "sessions": lambda s: windows.sessions(s, ["k"], F.when(F.col("k") == "a", "30 minutes").otherwise("5 minutes")),
    }
    found = {}
    for name, make in made.items():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = runs.finish(make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").outputMode("append"), f"{tmp_path}/{name}-check")
        rows = spark.read.parquet(f"{tmp_path}/{name}").withColumns({c: F.unix_seconds(c) - int(T0.timestamp()) for c in ("start", "end")}).collect()
        found[name] = sorted((r["k"], r["start"] // 60, r["end"] // 60, r["n"], r["value"]) for r in rows if r["k"] != "c")
        assert runs.too_late(q) == (2 if name == "sliding" else 1)
    assert found["tumbling"] == [("a", 0, 60, 2, 2.0), ("a", 120, 180, 2, 10.0)]
    assert found["sliding"] == [("a", -30, 30, 2, 2.0), ("a", 0, 60, 2, 2.0), ("a", 90, 150, 2, 10.0), ("a", 120, 180, 2, 10.0)]
    assert found["sessions"] == [("a", 0, 50, 2, 2.0), ("a", 120, 151, 2, 10.0)]


def test_requests_go_on_after_a_restart(spark, tmp_path):
    from spanforge.sources.requests import read_requests, stream_requests
    from spanforge.streaming import runs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_hidden").write_text("no\n")
    for i, lines in enumerate((['{"a": 1}', "", '{"a": 2}'], ['{"a": 3}'])):
        (tmp_path / "in" / f"part-{9 - i}").write_text("\n".join(lines) + ("\n" if i else ""))
        q = runs.finish(stream_requests(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/check")
        assert sum(p["numInputRows"] for p in q.recentProgress) == 2 - i
    got = sorted((r["file"], r["place"], json.loads(r["message"])["a"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("part-8", 0, 3), ("part-9", 0, 1), ("part-9", 10, 2)]
    assert sorted(tuple(r)[:2] for r in read_requests(spark, str(tmp_path / "in")).collect()) == [x[:2] for x in got]
    (tmp_path / "none").mkdir()
    assert read_requests(spark, str(tmp_path / "none")).count() == 0
