"""Operators on ordered rows against plain loops, over few and many ranges: numbering, the scan join, greedy gaps, sliding percentiles, means of intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

RNG = np.random.default_rng(11)
FRAMES = [(e, int(f)) for e in ("a", "b", "c", None) for f in RNG.permutation(60)] + [("a", None), ("d", 5), ("a", 7)]
SPANS = [("abc"[RNG.integers(3)], int(s), int(s + RNG.integers(-2, 25)), int(RNG.integers(4)), i) for i, s in enumerate(RNG.integers(-5, 62, 40))] + [(None, 0, 9, 0, 90), ("a", None, 9, 0, 91), ("z", 0, 9, 0, 92)]


@pytest.fixture(params=[1, 7])
def ranges(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def held(e, f, closed):
    if e is None or f is None:
        return []
    return [x for x in SPANS if x[0] == e and x[1] is not None and x[1] <= f and (f <= x[2] if closed else f < x[2])]


@pytest.mark.parametrize("closed", [False, True])
def test_scan_join(spark, ranges, closed):
    from spanforge.operators.scan import scan_join

    frames = spark.createDataFrame(FRAMES, "episode_index string, frame_index int").repartition(3)
    spans = spark.createDataFrame(SPANS, "episode_index string, start_frame long, end_frame long, rank int, name int").repartition(2)
    every = sorted(((e, f, x[4]) for e, f in FRAMES for x in held(e, f, closed)), key=str)
    got = scan_join(frames, spans, closed=closed)
    assert got.columns == ["episode_index", "frame_index", "rank", "name"]
    assert sorted(((r[0], r[1], r[3]) for r in got.collect()), key=str) == every and len(every) > 300
    best = [(e, f, min(held(e, f, closed), key=lambda x: (x[3], x[1]), default=(None,) * 5)) for e, f in FRAMES]
    first = scan_join(frames, spans, first_by=["rank"], closed=closed, how="left")
    start = {x[4]: x[1] for x in SPANS} | {None: None}
    assert sorted(((r[0], r[1], r[2], start[r[3]]) for r in first.collect()), key=str) == sorted(((e, f, x[3], x[1]) for e, f, x in best), key=str)
    left = scan_join(frames, spans, closed=closed, how="left").collect()
    assert len(left) == len(every) + sum(not held(e, f, closed) for e, f in FRAMES)
    assert scan_join(frames.filter("frame_index > 99"), spans).count() == 0 == scan_join(frames, spans.filter("rank > 99")).count()
    assert scan_join(frames, spans.filter("rank > 99"), how="left").count() == len(FRAMES)


def test_scan_join_keeps_frames_at_the_edge_of_a_range(spark, ranges):
    from spanforge.operators.scan import scan_join

    spark.conf.set("spark.sql.shuffle.partitions", str(ranges * 6))
    frames = spark.range(300).selectExpr("id div 100 as episode_index", "id % 100 as frame_index")
    spans = spark.range(60).selectExpr("id div 20 as episode_index", "id % 20 * 5 as start_frame", "id % 20 * 5 + 5 as end_frame", "id as name")
    assert scan_join(frames, spans).count() == 300
    assert scan_join(frames, spans, closed=True).count() == 357
    assert scan_join(frames, spans, first_by=["name"], how="left").filter("name = episode_index * 20 + frame_index div 5").count() == 300


def test_scan_join_has_no_range_predicate(spark):
    from spanforge.operators.scan import scan_join

    frames = spark.createDataFrame(FRAMES, "episode_index string, frame_index int")
    spans = spark.createDataFrame(SPANS, "episode_index string, start_frame long, end_frame long, rank int, name int")
    plan = scan_join(frames, spans)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "start_frame#" in plan


def test_numbers_run_through_all_ranges(spark, ranges):
    from spanforge.operators.ordering import numbered, share

    rows = spark.createDataFrame([(int(x), i) for i, x in enumerate(RNG.integers(0, 20, 300))] + [(None, 300)], "k int, i int").repartition(5)
    got = numbered(rows, [F.col("k"), -F.col("i")], "number").collect()
    wanted = sorted(got, key=lambda r: (r["k"] is not None, r["k"] or 0, -r["i"]))
    assert [r["number"] for r in wanted] == list(range(301))
    ties = numbered(rows, [F.col("k")]).collect()
    assert sorted(r["number"] for r in ties) == list(range(301)) and [r["k"] for r in sorted(ties, key=lambda r: r["number"])] == [r["k"] for r in wanted]
    parts = [share(rows, [F.col("k"), F.col("i")], 4, w).collect() for w in range(4)]
    assert [len(p) for p in parts] == [76, 75, 75, 75] and sorted(r["i"] for p in parts for r in p) == list(range(301))
    assert numbered(rows.filter("i > 999"), [F.col("k")]).count() == 0


def test_greedy_gap(spark, ranges):
    from spanforge.operators.sequence import greedy_gap

    rows, wanted = [], set()
    for e in range(5):
        t = np.cumsum(RNG.exponential(1.0, 200)) + RNG.normal(0, 2.0, 200)  # not in order everywhere
        last = None
        for i, x in enumerate(t):
            rows.append((e, i, None if i % 50 == 0 else float(x)))
            if i % 50 and (last is None or x - last >= 4.0):
                wanted.add((e, i))
                last = x
    got = greedy_gap(spark.createDataFrame(rows, "episode_index long, frame_index long, at double").repartition(3), "at", 4.0).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted) > 100
    one = spark.createDataFrame([(1, 5, 2.0)], "episode_index long, frame_index long, at double")
    assert [tuple(r) for r in greedy_gap(one, "at", 1.0).collect()] == [(1, 5)] and greedy_gap(one.filter("at > 9"), "at", 1.0).count() == 0


@pytest.mark.parametrize("chunk", [7, 1 << 14])
def test_sliding_percentiles(spark, chunk):
    from spanforge.operators.sequence import boundary_confidence

    rows = [(e, 3 * i, None if (i * 7 + e) % 23 == 0 else float(RNG.integers(0, 9)), "x") for e, n in ((1, 50), (2, 4), (3, 1), (4, 33)) for i in range(n)]
    got = boundary_confidence(spark.createDataFrame(rows, "episode_index long, frame_index long, value double, low_text string").repartition(3), "value", 5, chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [v for e, f, v, _ in rows if e == r["episode_index"] and abs(f - r["frame_index"]) <= 15 and v is not None]
        assert (r["p80"], r["low"]) == (pytest.approx(np.percentile(own, 80)), min(own)) if own else r["p80"] is None
        if r["value"] is not None:
            assert r["pause"] == pytest.approx(min(1, max(0, (np.percentile(own, 80) - r["value"]) / max(np.percentile(own, 80) - min(own), 1e-6))))


def test_means_of_intervals(spark):
    from spanforge.operators.sequence import interval_means

    samples = [(e, f, float(RNG.integers(9))) for e in (1, 2) for f in range(3, 60, 4)]
    spans = [(e, i, int(a), int(a + RNG.integers(0, 12))) for e in (1, 2) for i, a in enumerate(RNG.integers(0, 70, 30))]
    got = interval_means(spark.createDataFrame(samples, "episode_index long, frame_index long, x double"), "x", spark.createDataFrame([*spans, (3, 0, 0, 9)], "episode_index long, seg_id long, start_frame long, end_frame long"))
    wanted = {}
    for e, i, a, b in spans:
        own = [(f, x) for k, f, x in samples if k == e]
        wanted[e, i] = np.mean([x for f, x in own if a <= f < b] or [next((x for f, x in own if f >= (a + b) // 2), own[-1][1])])
    assert {(r[0], r[1]): r[2] for r in got.collect()} == pytest.approx(wanted)


def test_rewrite_sorted_numbers_rows_over_files_and_splits(spark, ranges, tmp_path):
    from spanforge.sinks.writers import rewrite_sorted, written_places

    path = str(tmp_path / "lines")
    spark.range(5000).selectExpr("""'{"event_id": ' || (id * 7919 % 5000 * 1000) || ', "index": ' || (id * 7919 % 5000 % 3) || '}' as value""").repartition(3).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits a file, several files a task
    try:
        rows = written_places(rewrite_sorted(spark, path, "event_id long, index long", "index", "event_id")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["index"], r["event_id"]) for r in sorted(rows, key=lambda r: r["place"])] == sorted((i % 3, i * 1000) for i in range(5000))
    assert sorted(r["place"] for r in rows) == list(range(1, 5001))


@pytest.mark.parametrize("splits", [128, 1])
def test_rewrite_sorted_query(spark, ranges, splits, tmp_path):
    from spanforge.plans import registry

    columns = ["id as event_id", "timestamp_seconds(id) as ts", "id % 50 as user_id", "'view' as event_type", "1D as value", """'{"k": ' || (id * 7919 % 40) || '}' as props"""]
    spark.range(999_000, 1_003_000).selectExpr(*columns).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{splits * 1024}")
    try:
        got = registry.queries()["k_rewrite_sorted"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted = sorted((i * 7919 % 40, i) for i in range(999_000, 1_003_000) if i % 4)
    assert sorted((r["place"], r["event_id"]) for r in got) == [(n + 1, i) for n, (_, i) in enumerate(wanted)]
