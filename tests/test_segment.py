"""Features and the solver against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest

from spanforge.functions import images as im
from spanforge.operators import features as ft
from spanforge.operators import segment as sg


def brute(motion, samples, cost, t, s):
    """Least total cost over every choice of candidates."""
    n, k = len(motion), len(t.part)

    def pool(i, e):
        reach = int(max(s.reach[1], min(s.reach[2], s.reach[0] * max(t.part[i], t.part[i + 1]) * n)))
        lo, hi = max(1, e - reach), min(n - 1, e + reach)
        a, b = max(1, lo), min(n - 2, hi)
        found = {int(f) for f in samples if lo <= f <= hi} | {e} | {f for f in range(a + 1, b) if motion[f] <= motion[f - 1] and motion[f] <= motion[f + 1]}
        best = sorted(found, key=lambda f: (motion[min(max(f, 0), n - 1)], abs(f - e), f))[: s.keep]
        return sorted({max(1, min(n - 1, f)) for f in [*best, e]})

    def price(seg, a, b):
        inside = [i for i, f in enumerate(samples) if a <= f < b]
        if not inside:
            later = [i for i, f in enumerate(samples) if f >= (a + b) // 2]
            inside = [later[0] if later else len(samples) - 1]
        want = max(t.part[seg] * n, s.least)
        return sum(cost[i][seg] for i in inside) / len(inside) + s.duration_weight * ((b - a - want) / max(want, 1)) ** 2

    best = (math.inf, None)
    for path in itertools.product(*[pool(i, e) for i, e in enumerate(t.expected(n))]):
        ends = [0, *path, n]
        if any(ends[i + 1] - ends[i] < max(t.least[i] * n * 0.45, s.least) for i in range(k)):
            continue
        total = sum(price(i, ends[i], ends[i + 1]) for i in range(k)) + s.motion_weight * sum(motion[b] for b in path)
        if total < best[0] - 1e-12:
            best = (total, list(path))
    return best[1]


def test_path_against_every_choice():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, k = int(rng.integers(20, 60)), int(rng.integers(2, 5))
        motion = np.round(rng.random(n), 3)
        samples = np.arange(0, n, int(rng.integers(1, 9)))
        cost = rng.random((len(samples), k))
        cuts = np.sort(rng.choice(np.arange(1, 20), k - 1, replace=False)) / 20
        t = sg.Template(np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [1]])), rng.random(k) * 0.2)
        s = sg.Search(least=int(rng.integers(1, 4)), keep=5, reach=(0.5, 4, 9), refine=0)
        wanted = brute(motion, samples, cost, t, s)
        if wanted is None:
            with pytest.raises(ValueError):
                sg.segment_path(motion, samples, cost, t, s)
        else:
            assert sg.segment_path(motion, samples, cost, t, s) == wanted
    assert sg.segment_path(motion, samples, cost, sg.Template(*[np.ones(1)] * 3)) == []


def test_refinement_and_confidence_by_loops():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, s = int(rng.integers(30, 90)), sg.Search(least=3, refine=6, near=7)
        motion, path = rng.random(n), sorted(rng.choice(np.arange(5, n - 5), 3, replace=False).tolist())
        t = sg.Template(np.array([0, 0.3, 0.5, 0.8]), np.array([0.3, 0.2, 0.3, 0.2]), np.zeros(4))
        out = []
        for i, b in enumerate(path):
            lo, hi = max(s.least if i == 0 else out[-1] + s.least, b - s.refine), min(n - s.least if i == 2 else path[i + 1] - s.least, b + s.refine)
            e = t.expected(n)[i]
            out.append(b if lo > hi else min(range(lo, hi + 1), key=lambda f: motion[f] + 0.08 * abs(f - e) / max(1, hi - lo)))  # noqa: B023
        assert sg.refine(motion, path, t.expected(n), s) == out
        for i, c in enumerate(sg.confidences(motion, path, t, s)):
            near = sorted(motion[max(0, path[i] - 7) : path[i] + 8])
            at = 0.8 * (len(near) - 1)
            high = near[int(at)] + (at - int(at)) * (near[min(int(at) + 1, len(near) - 1)] - near[int(at)])
            pause = (high - motion[path[i]]) / max(high - near[0], 1e-6)
            timing = math.exp(-abs(path[i] - t.expected(n)[i]) / max(80, 0.55 * max(t.part[i], t.part[i + 1]) * n))
            assert abs(c - min(1, max(0, 0.55 * pause + 0.45 * timing))) <= 5.1e-5


def test_models_and_documents(spark):
    """Fitted models against NumPy, and an episode like the labelled ones gets their boundaries."""
    rng, frames, segs = np.random.default_rng(5), [], []
    cuts = {0: [0, 30, 70, 100], 1: [0, 28, 72, 100], 2: [0, 50, 100], 9: [0, 31, 69, 100], 8: [0, 52, 100]}
    for e, c in cuts.items():
        for f in range(100):
            seg = sum(f >= x for x in c[1:-1])
            level = [1.0, 5.0, 9.0][seg] if len(c) == 4 else [20.0, 30.0][seg]
            frames.append((e, f, [level + rng.normal() * 0.05, 2.0], [level * 2 + rng.normal() * 0.05], 0.1 if f in c else 1.0))
        if e < 3:
            segs += [(e, i, c[i], c[i + 1], f" text {i}" if e else "other", "Pick") for i in range(len(c) - 1)]
    rows = spark.createDataFrame(frames, "episode_index long, frame_index long, state array<double>, visual array<double>, motion double")
    samples, motion = rows.filter("frame_index % 2 = 0").drop("motion"), rows.select("episode_index", "frame_index", "motion")
    segments = spark.createDataFrame(segs, "episode_index long, seg_id long, start_frame long, end_frame long, text string, skill string")
    episodes = spark.createDataFrame([(0, []), (1, ["sort"]), (2, ["other"]), (9, []), (8, ["mine"])], "episode_index long, tasks array<string>")
    s = sg.Search(least=5, reach=(0.5, 10, 40), refine=3, near=20)
    models = {(r["template"], r["modality"], r["seg_id"], r["dim"]): r for r in sg.fit_models(samples, segments, episodes).collect()}
    x = np.array([f[2][0] for f in frames if f[0] in (0, 1) and f[1] % 2 == 0])
    inside = np.array([f[2][0] for f in frames if f[0] in (0, 1) and f[1] % 2 == 0 and cuts[f[0]][1] <= f[1] < cuts[f[0]][2]])
    got = models[3, "state", 1, 0]
    assert abs(got["mean"] - ((inside - x.mean()) / x.std()).mean()) < 1e-9 and abs(got["var"] - max(1e-4, inside.var() / x.var())) < 1e-9
    docs, summary = sg.annotate(samples, motion, segments, episodes, s)
    found = {r["episode_index"]: r for r in summary.collect()}
    assert set(found) == {8, 9} and found[9]["num_subtasks"] == 3 and found[8]["matched_manual_episode"] == 2 and found[9]["error"] is None
    assert found[9]["boundaries"] == [31, 69] and found[8]["boundaries"] == [52] and 0 < found[9]["mean_confidence"] <= 1
    made = {r["episode_index"]: r for r in docs.collect()}
    assert made[9]["tasks"] == ["sort"] and made[8]["tasks"] == ["mine"] and [(x["start_frame"], x["end_frame"], x["action_text"]) for x in made[9]["action_config"]][0] == (0, 31, "other")


def test_a_segment_without_samples_has_its_middle(spark):
    samples = spark.createDataFrame([(0, f, [float(f)], [0.0]) for f in (0, 10, 20)], "episode_index long, frame_index long, state array<double>, visual array<double>")
    segments = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 3, 13), (0, 2, 13, 16), (0, 3, 16, 30)], "episode_index long, seg_id long, start_frame long, end_frame long")
    got = sorted((r["seg_id"], r["frame_index"]) for r in sg.labelled_samples(samples, segments).collect())
    assert got == [(0, 0), (1, 10), (2, 10), (3, 20)]


def test_images():
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (48, 64, 3)).astype("u1")
    f = im.frame_feature(image, 64, 48)
    rgb = image / 255
    assert len(f) == im.FEATURES == 68
    assert np.allclose(f[:3], rgb[:12, :16].mean(axis=(0, 1))) and np.allclose(f[48:51], rgb.mean(axis=(0, 1))) and np.allclose(f[51:54], rgb.std(axis=(0, 1))) and np.allclose(f[54:57], rgb[12:36, 16:48].mean(axis=(0, 1))) and abs(f[57:67].sum() - 1) < 1e-9
    assert np.array_equal(im.resize_area(np.kron(np.arange(12).reshape(3, 4), np.ones((5, 2))).astype("u1")[..., None], 4, 3)[..., 0], np.arange(12).reshape(3, 4))
    flat = np.zeros((20, 20), "u1")
    assert not im.edges(flat).any()
    flat[:, 10:] = 255
    found = im.edges(flat)
    assert found.any(axis=1).all() and found.sum() == 20 and set(np.nonzero(found)[1]) <= {9, 10}
    assert im.motion(flat, np.zeros_like(flat)) == 127.5
    padded = im.pad_resize(np.full((10, 20, 3), 9, "u1"), 8, 8)
    assert padded.shape == (8, 8, 3) and (padded[2:6] == 9).all() and not padded[:2].any()


def test_visual_pipeline(spark):
    """Two cameras of which one ends early: features of what both have, motion as by loops."""
    rng, rows, kept = random.Random(7), [], {}
    for cam, n in (("a", 7), ("b", 5)):
        for f in range(n):
            p = bytes(rng.randrange(256) for _ in range(8 * 8 * 3))
            rows.append((0, f, cam, p, 8, 8))
            kept[cam, f] = np.frombuffer(p, "u1").reshape(8, 8, 3)
    rows.append((1, 0, "a", rows[0][3], 8, 8))  # no camera b
    videos = spark.createDataFrame(rows, "episode_index long, frame_index long, camera string, pixels binary, width int, height int")
    s = ft.Settings(size=(8, 8), stride=2, smooth=1, visual_offsets=(0,))
    got = {r["frame_index"]: r["visual_motion"] for r in ft.visual_motion(videos, ["a", "b"], s).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0] == 0
    for f in range(1, 5):
        assert abs(got[f] - np.mean([im.motion(im.gray(kept[c, f]), im.gray(kept[c, f - 1])) for c in "ab"])) < 1e-9
    seen = {r["frame_index"]: r["visual"] for r in ft.visual_features(videos, ["a", "b"], s).collect()}
    assert sorted(seen) == [0, 2, 4] and len(seen[0]) == 2 * 68 * 3
    for f in seen:
        assert np.allclose(seen[f][:136], np.concatenate([im.frame_feature(kept[c, f], 8, 8) for c in "ab"]))
    states = spark.createDataFrame([(0, f, [float(f), 1.0]) for f in range(4)], "episode_index long, frame_index long, v array<double>")
    samples, motion = ft.episode_features(states, ["v", "none"], videos, ["a", "b"], s)
    assert sorted(r["frame_index"] for r in samples.collect()) == [0, 2] and motion.count() == 4
    with pytest.raises(ValueError):
        ft.state_features(states, ["none"])


@pytest.mark.parametrize("cells, most", [(4_000_000, 4096), (300, 7)])
def test_nearest_meets_every_model(spark, cells, most):
    from spanforge.operators.stats import nearest

    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 4, (90, 3)).astype(float), rng.integers(0, 4, (700, 3)).astype(float)  # with equal models, and equal scores
    lx, ly = rng.integers(1, 60, 90), rng.integers(1, 60, 700)
    targets = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, lx, strict=True))], "id long, v array<double>, length long")
    models = spark.createDataFrame([(f"m{i:03d}", v.tolist(), int(n)) for i, (v, n) in enumerate(zip(y, ly, strict=True))], "model string, mv array<double>, mlength long")
    found = nearest(targets, models, 2.0, cells, most)
    cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2) / 3) + 2.0 * np.abs(np.log(lx)[:, None] - np.log(ly)[None])
    got = {r["id"]: (r["model"], r["score"]) for r in found.collect()}
    assert {i: m for i, (m, _) in got.items()} == {i: f"m{int(c.argmin()):03d}" for i, c in enumerate(cost)}
    assert np.allclose([got[i][1] for i in range(90)], cost.min(axis=1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan  # pairs are made in arrays within tasks, not row by row
