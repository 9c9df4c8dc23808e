import random
from types import SimpleNamespace

import pytest

from spanforge.operators import intervals as iv

# Three sampling configurations at 30 frames a second, and the blocks they give for segments [0, 67) and [67, 170).
CONFIGS = {
    "a": ((9, 5, 3, 0.1, 1.7, 0.4, 1.5), {("uniform", 0, 0, 9, 2), ("transition", 1, 16, 5, 13), ("uniform", 1, 88, 9, 4), ("final_tail", 2, 125, 3, 15)}),
    "b": ((12, 6, 3, 0.2, 0.7, 0.5, 1.0), {("uniform", 0, 0, 12, 4), ("transition", 1, 46, 6, 6), ("uniform", 1, 94, 12, 4), ("final_tail", 2, 140, 3, 10)}),
    "c": ((30, 10, 3, 0.2, 0.7, 1.0, 1.5), {("uniform", 0, 0, 30, 2), ("transition", 1, 46, 10, 6), ("final_tail", 2, 125, 3, 15)}),
}
SEGMENTS = "episode_index long, seg_id long, start_frame long, end_frame long"


def config(t):
    return SimpleNamespace(fps=30.0, interleave=t[0], dense_step=t[1], tail_step=t[2], ignore_sec=t[3], tail_sec=t[4], head_sec=t[5], last_sec=t[6])


@pytest.mark.parametrize("name", CONFIGS)
def test_blocks(spark, name):
    t, wanted = CONFIGS[name]
    s = spark.createDataFrame([(0, 0, 0, 67), (0, 1, 67, 170)], SEGMENTS)
    found = iv.sampling_blocks(s, config(t)).collect()
    assert {(r["kind"], r["target"], r["first_frame"], r["step"], r["n"]) for r in found} == wanted
    assert iv.expand_frames(iv.sampling_blocks(s, config(t))).count() == sum(x[4] for x in wanted)


def test_blocks_of_odd_segments(spark):
    s = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 5, 5), (0, 2, 5, 6), (1, 0, 0, 0)], SEGMENTS)
    found = iv.sampling_blocks(s, config(CONFIGS["a"][0])).collect()
    assert {r["seg_id"] for r in found} <= {0, 2} and all(r["n"] > 0 for r in found)
    with pytest.raises(ValueError):
        iv.sampling_blocks(s, config((0, 1, 1, 0, 0, 0, 0)))


def test_coverage_against_cursor(spark):
    rng, rows, wanted = random.Random(5), [], {}
    for e in range(60):
        n, frames = rng.randint(1, 6), rng.randint(1, 9)
        ends = [rng.randint(-1, 10) for _ in range(n)]
        rows += [(e, i, x, frames) for i, x in enumerate(ends)]
        kept, cursor, out = ends[:frames], 0, []
        for i, x in enumerate(kept):
            end = frames - 1 if i == len(kept) - 1 else min(max(x, cursor), frames - 1 - (len(kept) - 1 - i))
            out.append((cursor, end))
            cursor = end + 1
        wanted[e] = out
    df = spark.createDataFrame(rows, "episode_index long, pos long, end_frame long, frames long")
    found = {}
    for r in sorted(iv.rebuild_coverage(df).collect(), key=lambda r: r["seg_id"]):
        found.setdefault(r["episode_index"], []).append((r["start_frame"], r["end_frame"]))
    assert found == wanted


def test_merge_prev_against_loop(spark):
    rng, rows, wanted = random.Random(6), [], {}
    for e in range(80):
        out = []
        for i in range(rng.randint(0, 7)):
            a, end = rng.choice(["keep", "merge_prev", "drop"]), rng.randint(0, 20)
            rows.append((e, i, i, end, a))
            if a == "keep":
                out.append([i, end])
            elif a == "merge_prev" and out:
                out[-1][1] = max(out[-1][1], end)
        if out:
            wanted[e] = out
    found = {}
    df = spark.createDataFrame(rows, "episode_index long, pos long, start_frame long, end_frame long, action string")
    for r in sorted(iv.merge_prev(df).collect(), key=lambda r: r["grp"]):
        found.setdefault(r["episode_index"], []).append([r["start_frame"], r["end_frame"]])
    assert found == wanted


def test_interval_join_in_buckets(spark):
    frames = spark.range(0, 500).selectExpr("id % 3 as episode_index", "id as frame_index")
    s = spark.createDataFrame([(0, 0, 0, 130), (0, 1, 130, 400), (1, 0, 10, 11), (2, 0, 490, 900)], SEGMENTS)
    a = iv.interval_join(frames, s).selectExpr("frame_index", "seg_id").collect()
    b = iv.interval_join(frames, s, bucket=64).selectExpr("frame_index", "seg_id").collect()
    assert sorted(a) == sorted(b) and a


def test_rewrite_against_cursor(spark):
    """Whole rewriting of made answers against a loop over each episode's segments."""
    import re

    from spanforge.operators import rewrite as rw

    rng, rows, wanted = random.Random(9), [], {}
    phrases = ["open the drawer", "pulls the drawer", "close the sliding tray", "pushes the tray in", "wait here", "moves to the cup", "drives to the table", "lift arm", "pick the cup", "stay idle", "closes the drawer", "drawer"]
    types = {"drawer": ("drawer",), "tray": ("sliding tray",)}
    for e in range(150):
        frames, kept = rng.randint(2, 14), []
        for pos in range(rng.randint(0, 8)):
            a = rng.randint(-3, 12)
            b, text, skill = a + rng.randint(-2, 7), rng.choice(phrases), rng.choice(["Open", "Close", "Pull", "Push", "Move", "Pick", "Dance"])
            rows.append((e, pos, pos % 3, a, b, text, skill, frames))
            a = max(0, a)
            b = max(a, min(frames - 1, b))
            like = next((k for k, v in types.items() if any(x in text for x in v)), None)
            if like and skill == "Open":
                skill, text = "Pull", re.sub(r"^(?:open|opens|opening)\s+", "pulls open ", text)
            elif like and skill == "Close":
                skill = "Push"
                if m := re.match(r"^(?:close|closes|closing)\s+(.*)", text):
                    text = f"pushes {m[1]} closed"
            aux = "prev" if text in ("wait here", "stay idle") else "next" if text.startswith("moves to ") else None
            base = "drive" in text
            if skill not in rw.SKILLS or (skill == "Move" and not base) or aux:
                if aux == "prev" and kept:
                    kept[-1]["end"] = max(kept[-1]["end"], b)
                continue
            kept.append({"start": a, "end": b, "check": b, "text": text, "skill": skill, "id": pos % 3, "pos": pos})
        kept.sort(key=lambda x: (x["start"], x["end"], x["id"], x["pos"]))
        merged = []
        for s in kept:
            kind = lambda t: next((k for k, v in types.items() if any(x in t for x in v)), None)
            p = merged[-1] if merged else None
            if p and p["skill"] == s["skill"] and s["skill"] in ("Pull", "Push") and kind(p["text"]) and kind(p["text"]) == kind(s["text"]):
                p["end"], p["check"] = max(p["end"], s["end"]), max(p["check"], s["check"])
                if s["text"].startswith(s["skill"].lower()):
                    p["text"] = s["text"]
            else:
                merged.append(dict(s))
        merged, cursor, out = merged[:frames], 0, []
        for i, s in enumerate(merged):
            end = frames - 1 if i == len(merged) - 1 else min(max(s["end"], cursor), frames - len(merged) + i)
            out.append((i, cursor, end, min(max(s["check"], cursor), end), s["text"], s["skill"]))
            cursor = end + 1
        if out:
            wanted[e] = out
    df = spark.createDataFrame(rows, "episode_index long, pos long, seg_id long, start_frame long, end_frame long, text string, skill string, frames long")
    found = {}
    for r in sorted(rw.rewrite_annotation(df).collect(), key=lambda r: r["seg_id"]):
        found.setdefault(r["episode_index"], []).append((r["seg_id"], r["start_frame"], r["end_frame"], r["check_frame"], r["text"], r["skill"]))
    assert found == wanted


def test_models(spark):
    """Retries, a policy whose batch fails, decoding by numbers and by times, metadata of broken files."""
    import io

    import numpy as np

    from spanforge.operators import models as md

    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError("not yet")
        return x

    assert md.with_retries(flaky)(7) == 7 and len(tries) == 3
    assert md.with_retries(lambda: "", 2, good=bool)() == ""
    with pytest.raises(OSError):
        md.with_retries(lambda: (_ for _ in ()).throw(OSError("never")), 2)()
    frames = np.arange(6 * 2 * 3 * 3, dtype="u1").reshape(6, 2, 3, 3)
    out = io.BytesIO()
    np.savez(out, frames=frames, fps=10.0)
    blobs = spark.createDataFrame([("a", out.getvalue(), [4, 1, 1, 99, -2], [0.0, 0.25, 9.0]), ("b", b"no video", [], None)], "path string, content binary, numbers array<long>, seconds array<double>")
    info = {r["path"]: r for r in md.video_metadata(blobs).collect()}
    assert (info["a"]["fps"], info["a"]["frames"], info["a"]["width"], info["a"]["height"]) == (10.0, 6, 3, 2) and info["b"]["error"]
    got = md.decode_frames(blobs, "numbers").collect()
    assert [(r["frame_index"], bytes(r["pixels"])) for r in got] == [(1, frames[1].tobytes()), (4, frames[4].tobytes())]
    near = md.decode_at(blobs.filter("path = 'a'"), "seconds").collect()
    assert [r["frame_index"] for r in near] == [0, 2, 5]
    rows = spark.createDataFrame([(i, i % 3) for i in range(7)], "id long, k long").coalesce(1)
    made = md.predict(rows, lambda: lambda part: [{"answer": 10 // r["k"]} for r in part], "id long, answer long, error string", batch=2)
    assert {r["id"]: (r["answer"], r["error"] is None) for r in made.collect()} == {0: (None, False), 1: (None, False), 2: (None, False), 3: (None, False), 4: (10, True), 5: (5, True), 6: (None, False)}


def test_sessions_reset(spark):
    """reset_memory begins anew."""
    from spanforge.streaming import sessions

    rows = [("a", 1, "one", False, False), ("a", 2, "", False, False), ("a", 3, "three", False, True), ("a", 4, "four", True, False), ("b", 1, None, False, False), ("b", 2, "two", False, False), ("b", 3, "x", False, True), ("b", 4, "", False, False)]
    df = spark.createDataFrame(rows, "episode_index string, sample_id long, pred string, skip boolean, reset_memory boolean")
    wanted = {("a", 1): ("start", "one"), ("a", 2): ("one", "one"), ("a", 3): ("start", "three"), ("a", 4): ("three", "three"), ("b", 1): ("start", "start"), ("b", 2): ("start", "two"), ("b", 3): ("start", "x"), ("b", 4): ("x", "x")}
    assert {(r[0], r[1]): (r[2], r[3]) for r in sessions.replay(df, "start").collect()} == wanted
