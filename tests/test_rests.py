"""Listings, configs, prompts, posts and settings on cases of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

VIDEOS = ["r/cam_high/episode_000007.mp4", "r/my_right_cam/ep-000007.MKV", "r/left/episode_000007.mp4", "r/left/7/other.mp4", "r/cam_high/episode_000008.mp4", "r/notes/episode_000007.txt"]
CONFIGS = [(0, "robo-Long", "long"), (1, "robo_subtask_val", "val"), (2, "robo_kitchen", "x"), (3, "other_counting", "counting"), (4, "ROBO_spatial", "spatial")]


def test_videos_are_discovered(spark):
    from spanforge.sources import files as fl

    files, keys = spark.createDataFrame([(v,) for v in VIDEOS], "path string"), ["observation.cam_high", "left", "right", "gripper"]
    wanted = {"observation.cam_high": (VIDEOS[0], None), "right": (VIDEOS[1], None), "left": (VIDEOS[2], None), "gripper": (None, "missing")}
    assert {r["key"]: (r["path"], r["issue"]) for r in fl.discover_videos(files, keys, 7).collect()} == wanted
    each = fl.discover_each(files, keys, spark.createDataFrame([(7,), (8,), (9,), (7,)], "episode_index long")).collect()
    assert {r["key"]: (r["path"], r["issue"]) for r in each if r["episode_index"] == 7} == wanted and len(each) == 12
    assert {(r["episode_index"], r["key"]): r["path"] for r in each if r["path"] and r["episode_index"] > 7} == {(8, "observation.cam_high"): VIDEOS[4]}
    other = {r["key"]: r["issue"] for r in fl.discover_videos(files, ["cam_high", "ep", "cam.my_right_cam"]).collect()}
    assert other == {"cam_high": "ambiguous_exact", "ep": "ambiguous_fuzzy", "cam.my_right_cam": None}
    alone = spark.createDataFrame([("r/left/7/a.mkv",), ("r/left/70/a.mkv",), ("r/left/007/b.mkv",)], "path string")  # a number counts plain or padded to six or eight digits
    for found in (fl.discover_videos(alone, ["left"], 7), fl.discover_each(alone, ["left"], spark.createDataFrame([(7,)], "episode_index long"))):
        assert [r["path"] for r in found.collect()] == ["r/left/7/a.mkv"]


def test_views_beside_a_head(spark):
    from spanforge.sources import files as fl

    files = ["r/observation.images.cam_high/e1.mp4", "r/observation.images.cam_left_wrist/e1.mp4", "q/top/e2.mp4", "q/a_Right_Wrist/e2.mp4", "q/b_right_wrist/e2.mp4", "q/left_wrist/other.mp4"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    got = {(r["path"], r["view"]): r["view_path"] for r in fl.sibling_views(frame([files[0], files[2]]), frame(files)).collect()}
    assert got == {(files[0], "head"): files[0], (files[0], "left"): files[1], (files[2], "head"): files[2], (files[2], "right"): files[3]}


def test_configs(spark):
    from spanforge.sources import configs as cf

    rows = cf.resolve_configs(spark, " annotation_path=a/b/e.jsonl ; sample_interleave = 8, annotation_path=e.json,annotation_path=x/e.json;data_path=/v,").orderBy("pos").collect()
    assert [r["config"]["data_path"] for r in rows] == ["a/b", ".", "/v"] and rows[0]["config"]["sample_interleave"] == "8"
    c = spark.createDataFrame(CONFIGS, "pos long, dataset_name string, task_type string")
    picked = lambda *a: [r["pos"] for r in cf.pick_config(c, *a).collect()]
    assert (picked("Robo"), picked("", "robo-spatial"), picked("other"), picked("nothing")) == ([0], [4], [3], [])
    sliced = lambda *a: sorted(r["pos"] for r in cf.slice_configs(c, *a).collect())
    assert (sliced(), sliced("counting"), sliced("val"), sliced("", "robo"), sliced("x", "robo")) == ([0, 1, 2, 3, 4], [3], [1], [1, 2], [2])
    with pytest.raises(ValueError, match="no dataset"):
        cf.slice_configs(c, "counting", "robo")


def test_settings_and_endpoints():
    from spanforge.functions.requests import endpoints, first_setting

    held = {"A": " ", "B": " b ", "C": "c"}
    assert (first_setting(held, ["X", "A", "B", "C"], "d"), first_setting(held, ["A"], "d")) == ("b", "d")
    assert (endpoints(" x, ,y ", "d"), endpoints(None, "d"), endpoints(" , ", "d")) == (["x", "y"], ["d"], ["d"])


def test_images_of_floats():
    from spanforge.functions.images import to_bytes

    held = np.array([-1.0, 0.0, 0.5, 1.0, 2.0])
    assert to_bytes(held).tolist() == [0, 0, 127, 255, 255] and to_bytes(np.array([7], "u1")).tolist() == [7]


def test_quota_of_less_than_one_a_group(spark):
    from spanforge.operators.sampling import quota

    rows = spark.range(40).withColumn("g", F.col("id") % 10)
    assert [len(quota(rows, "g", "id", n, "s").collect()) for n in (7, 10, 25, 0)] == [7, 10, 20, 0]
    merged = rows.orderBy(F.md5(F.concat_ws("|", F.lit("s"), "g", "id")), "id").limit(7)
    assert sorted(quota(rows, "g", "id", 7, "s").collect()) == sorted(merged.collect())


def test_rates_known_by_name(spark):
    from spanforge.sources.files import fallback_fps

    rows = spark.createDataFrame([("x/AgiBot_Subtask_val",), ("other",)], "n string")
    assert [r[0] for r in rows.select(fallback_fps(F.col("n"))).collect()] == [30.0, None]


def test_empty_and_blank_files(spark, tmp_path):
    from spanforge.sources.files import read_json_or_jsonl

    for name, text in (("empty", ""), ("blank", " \n\n"), ("array", ' \n [{"a": 1}]'), ("lines", '\n{"a": 1}\n')):
        (tmp_path / name).write_text(text)
        assert [r["json"] for r in read_json_or_jsonl(spark, str(tmp_path / name)).collect()] == ([] if name in ("empty", "blank") else ['{"a":1}' if name == "array" else '{"a": 1}'])


def test_rescored_asks_once(spark):
    from spanforge.operators import models as md

    calls = spark.sparkContext.accumulator(0)

    def judge(a, b):
        calls.add(1)
        return md.overlap_judge(a, b)

    rows = [(i, 0.2 if i < 8 else 0.9, said, "open it", None) for i, said in enumerate(["open it", " open it ", "open it now", "", None, "open it", "open it now", "open it", "open it now"])]
    details = spark.createDataFrame(rows, "i int, subtask_judge_score double, pred_current_subtask string, neighbor_previous_subtask string, neighbor_next_subtask string").coalesce(1)
    got = {r["i"]: (r["neighbor_prev_judge_score"], r["neighbor_next_judge_score"]) for r in md.rescored(details, 0.5, lambda: judge).collect()}
    assert got[0] == got[1] == (1.0, 0.0) and got[3] == got[4] == (0.0, 0.0) and got[8] == (None, None) and 0 < got[2][0] < 1
    assert calls.value == 2


def test_posts(spark, tmp_path):
    """A bad post leaves what was saved; of several good ones the last counts; limits hold for what was announced."""
    import json

    from spanforge.sinks.posted import SAVED, save

    episodes = spark.createDataFrame([(1, 10), (2, 4), (3, 0)], "episode_index long, length long")
    form = lambda *ends, **more: json.dumps({"task_text": " t ", "action_config": [{"end_frame": e, "action_text": f" a{e}", "skill": "Pick"} for e in ends], **more}).encode()
    posts = [
        (1, 1, None, form(4, 10), None), (2, 1, None, form(5, 10, task_text="new"), None), (3, 1, None, form(5, 9), "not_covered"), (4, 2, "0", form(4), "missing body"), (5, 2, "x", form(4), "invalid length"),
        (6, 2, str(10 * 1024 * 1024 + 1), form(4), "too long"), (7, 2, None, b"\xff\xfe{}", "no JSON"), (8, 2, None, b"[]", "no object"), (9, 2, None, form(3, 3), "not_increasing"), (10, 9, None, form(3), "no episode"),
        (11, 2, str(10 * 1024 * 1024), form(4, extra="é"), None), (12, 2, None, form("four"), "no_number"), (13, 2, None, b"", "missing body"), (14, 2, None, form(), "empty"),
    ]
    rows = [(n, e, str(len(b)) if h is None else h, bytearray(b)) for n, e, h, b, _ in posts]
    told = save(spark.createDataFrame(rows, "number long, episode_index long, header string, body binary"), episodes, f"{tmp_path}/saved")
    assert {r["number"]: r["error"] for r in told.collect()} == {p[0]: p[4] for p in posts}
    held = {r["episode_index"]: (r["length"], r["task_text"], [(s["start_frame"], s["end_frame"], s["action_text"]) for s in r["action_config"]]) for r in spark.read.schema(SAVED).json(f"{tmp_path}/saved").collect()}
    assert held == {1: (10, "new", [(0, 5, "a5"), (5, 10, "a10")]), 2: (4, "t", [(0, 4, "a4")])}
