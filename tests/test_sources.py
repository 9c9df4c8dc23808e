"""Sources that read no more than what is asked for."""

import json

import numpy as np


def dataset(tmp_path, n=500):
    (tmp_path / "meta").mkdir()
    lines = [json.dumps({"episode_index": i, "length": i + 1, "tasks": ["t"] * (i % 3), "action_config": [{"action_text": "x" * 300}]}) for i in range(n)]
    (tmp_path / "meta" / "episodes.jsonl").write_text("\n".join(lines))
    (tmp_path / "meta" / "info.json").write_text('{"fps": 5}')
    return str(tmp_path)


def test_point_read_parses_one_line(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    from spanforge.sources import episodes as es

    path = dataset(tmp_path)
    es.write_places(spark, path)
    parsed, read = [], json.loads
    monkeypatch.setattr(es.json, "loads", lambda x: parsed.append(x) or read(x))
    index = ("episode_index",)
    for tests, wanted, lines in (
        ([EqualTo(index, 77)], [77], 1), ([In(index, (3, 499, 9999))], [3, 499], 2), ([GreaterThanOrEqual(index, 10), LessThan(index, 13)], [10, 11, 12], 3), ([EqualTo(index, -1)], [], 0),
        ([EqualTo(("length",), 5)], list(range(500)), 500),
    ):
        reader = es._Choosy({"path": path}, ["episode_index", "length"])
        assert list(reader.pushFilters(tests)) == [t for t in tests if t.attribute != index]
        parsed.clear()
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert rows == [(i, i + 1) for i in wanted] and len(parsed) == lines


def test_predicates_reach_the_source(spark, tmp_path):
    from spanforge.sources import episodes as es

    path, setting = dataset(tmp_path), "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(setting)
    es.write_places(spark, path)
    spark.conf.set(setting, "true")
    try:
        one = es.read_dataset(spark, path, columns="length long, episode_index long, fps double").filter("episode_index = 42")
        assert one.rdd.getNumPartitions() == 1 and [tuple(r) for r in one.collect()] == [(43, 42, 5.0)]
        some = es.read_dataset(spark, path).filter("episode_index in (1, 2) and length > 2")
        assert [(r["episode_index"], r["tasks"]) for r in some.collect()] == [(2, ["t", "t"])]
        with open(f"{path}/meta/episodes.jsonl", "a") as f:  # the places that were noted are of another file now
            f.write('\n{"episode_index": 42, "length": 7}')
        assert sorted(r["length"] for r in es.read_dataset(spark, path).filter("episode_index = 42").collect()) == [7, 43]
    finally:
        spark.conf.set(setting, before)


def test_frames_are_read_up_to_the_last(spark, tmp_path):
    from spanforge.operators.decode import decode, frame_reader

    held = np.random.default_rng(0).integers(0, 256, (50, 4, 6, 3), dtype="u1")
    for name in ("a", "b"):
        np.save(tmp_path / f"{name}.npy", held if name == "a" else held[:3])
    a, b = (str(tmp_path / f"{n}.npy") for n in "ab")
    asked = spark.createDataFrame([(a, 7), (a, 2), (a, 7), (a, -1), (a, None), (b, 2), (b, 40), (b, 0)], "path string, frame_index int").repartition(3)
    got = decode(asked).collect()
    assert sorted((r["path"], r["frame_index"]) for r in got) == [(a, 2), (a, 7), (b, 0), (b, 2)]
    assert all(bytes(r["pixels"]) == held[r["frame_index"]].tobytes() and (r["width"], r["height"]) == (6, 4) for r in got)
    assert decode(asked.filter("frame_index > 99")).count() == 0

    seen = []
    make = frame_reader(lambda file: (seen.append(i) or held[i] for i in range(50)), lambda path: open(path, "rb"))()  # noqa: SIM115
    for i in (4, 9):
        make.eval({"path": a, "frame_index": i})
    assert [r[1] for r in make.terminate()] == [4, 9] and seen == list(range(10))


def test_episode_files_are_written_by_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanforge.sinks.writers import write_episode_files
    from spanforge.sources.files import read_episodes

    frames = spark.range(30_000).select(F.when(F.col("id") < 25_000, 7).otherwise(F.col("id") % 120).alias("episode_index"), F.col("id").alias("frame_index"))
    frames = frames.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("episode_index"), F.col("id").alias("frame_index"))).repartition(5)
    assert write_episode_files(frames, str(tmp_path / "data"), 50) == 120
    found = sorted(p.relative_to(tmp_path / "data").as_posix() for p in (tmp_path / "data").rglob("*.parquet"))
    assert found == [f"chunk-{i // 50:03d}/episode_{i:06d}.parquet" for i in range(120)]
    rows = read_episodes(spark, str(tmp_path / "data"))
    assert sorted(map(tuple, rows.select("episode_index", "frame_index").collect())) == sorted((7 if i < 25_000 else i % 120, i) for i in range(30_000))
