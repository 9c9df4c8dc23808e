"""Policies, judges and decoders as table functions: each is made once a task and sees batches."""

from __future__ import annotations

import io
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.score import LEVELS


def with_retries(f: Callable, attempts: int = 3, wait: float = 0.0, good: Callable[[object], bool] = lambda x: True) -> Callable:
    """f, called again after an error or an answer that isn't good, each wait twice as long as the last. The last error is raised, the last answer returned."""

    def run(*args):
        pause = wait
        for i in range(attempts):
            try:
                out = f(*args)
                if good(out) or i == attempts - 1:
                    return out
            except Exception:
                if i == attempts - 1:
                    raise
            time.sleep(pause)
            pause *= 2

    return run


def predict(rows: DataFrame, make: Callable[[], Callable[[list[dict]], list[dict]]], schema: str, batch: int = 4) -> DataFrame:
    """What a policy answers to rows, `batch` at a time. make() is called once a task; a row whose batch fails has its message in `error`, a column of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        policy = make()
        for b in batches:
            asked, out = b.to_dict("records"), []
            for i in range(0, len(asked), batch):
                part = asked[i : i + batch]
                try:
                    found = policy(part)
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} answers to {len(part)} rows")
                    out += [{**r, **a, "error": None} for r, a in zip(part, found, strict=True)]
                except Exception as e:  # said in the row, not raised
                    out += [{**r, "error": str(e)} for r in part]
            yield pd.DataFrame([[r.get(c) for c in names] for r in out], columns=names)

    return rows.mapInPandas(run, schema)


def overlap_judge(reference: str, answer: str) -> dict:
    """A judge without a model: words in common (Jaccard) on the scale of LEVELS, 1 only for equal words in order."""
    a, b = (re.findall(r"[a-z0-9]+", (x or "").lower()) for x in (reference, answer))
    if not a or not b:
        return {"subtask_score": 0.0, "reason": "empty"}
    if a == b:
        return {"subtask_score": 1.0, "reason": "same words"}
    part = len(set(a) & set(b)) / len(set(a) | set(b))
    return {"subtask_score": LEVELS[2] if part >= 0.75 else LEVELS[1] if part >= 0.4 else LEVELS[0], "reason": f"{part:.2f} of the words"}


def judged(rows: DataFrame, reference: str, answer: str, make: Callable[[], Callable[[str, str], dict]] = lambda: overlap_judge) -> DataFrame:
    """rows with subtask_score and reason by a judge, which is made once a task; its answers pass through JSON as a model's would."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", subtask_score double, reason string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = with_retries(make())
        for b in batches:
            said = [json.loads(json.dumps(judge(r, a))) for r, a in zip(b[reference], b[answer], strict=True)]
            yield b.assign(subtask_score=[float(x.get("subtask_score", 0.0)) for x in said], reason=[str(x.get("reason", "")) for x in said])

    return rows.mapInPandas(run, schema)


def rescored(details: DataFrame, least: float, make: Callable[[], Callable[[str, str], dict]] = lambda: overlap_judge) -> DataFrame:
    """details with neighbor_prev_judge_score and neighbor_next_judge_score: stored answers under `least` held by a judge against the subtasks before and after.

    details: (subtask_judge_score, pred_current_subtask, neighbor_previous_subtask, neighbor_next_subtask, ...). A blank answer or neighbour scores 0 without a judge; other rows have nulls. Only
    texts that are asked about go to the judge, each pair of them once.
    """
    low = F.col("subtask_judge_score") < least
    sides = {"neighbor_prev_judge_score": "neighbor_previous_subtask", "neighbor_next_judge_score": "neighbor_next_subtask"}
    asked = None
    for side in sides.values():
        pairs = details.filter(low).select(F.trim(side).alias("__r"), F.trim("pred_current_subtask").alias("__a")).filter("__r <> '' and __a <> ''")
        asked = pairs if asked is None else asked.union(pairs)
    scores = judged(asked.distinct(), "__r", "__a", make).select("__r", "__a", "subtask_score")
    out = details
    for name, side in sides.items():
        s = scores.withColumnsRenamed({"__r": f"__r{name}", "__a": f"__a{name}", "subtask_score": f"__s{name}"})
        out = out.join(s, (F.trim(out[side]) == s[f"__r{name}"]) & (F.trim(out["pred_current_subtask"]) == s[f"__a{name}"]), "left")
        out = out.withColumn(name, F.when(low, F.coalesce(f"__s{name}", F.lit(0.0)))).drop(f"__r{name}", f"__a{name}", f"__s{name}")
    return out


class ArrayVideo:
    """A decoder of videos kept as NumPy archives: `frames` (n, height, width, 3) bytes and `fps`. Others have the same three methods."""

    def __init__(self, content: bytes) -> None:
        held = np.load(io.BytesIO(content))
        self.held, self.fps = held["frames"], float(held["fps"]) if "fps" in held else None

    def info(self) -> dict:
        n, h, w = self.held.shape[:3]
        return {"fps": self.fps, "frames": n, "width": w, "height": h}

    def times(self) -> Iterator[float]:
        return (i / (self.fps or 1.0) for i in range(len(self.held)))

    def frames(self) -> Iterator[np.ndarray]:
        return iter(self.held)


def video_metadata(blobs: DataFrame, decoder: Callable[[bytes], object] = ArrayVideo, default_fps: float = 30.0) -> DataFrame:
    """(path, fps, frames, width, height, error) of blobs (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    i = decoder(c).info()
                    out.append((p, float(i["fps"] or default_fps), i["frames"], i["width"], i["height"], None))
                except Exception as e:
                    out.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "fps", "frames", "width", "height", "error"]).astype({c: "Int64" for c in ("frames", "width", "height")})

    return blobs.select("path", "content").mapInPandas(run, "path string, fps double, frames long, width long, height long, error string")


PIXELS = "path string, frame_index long, width int, height int, pixels binary"


def decode_frames(blobs: DataFrame, wanted: str, decoder: Callable[[bytes], object] = ArrayVideo) -> DataFrame:
    """PIXELS of the frames that `wanted` (a column of arrays of numbers) names, each once, in order; decoding stops at the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c, numbers in zip(b["path"], b["content"], b[wanted], strict=True):
                left = sorted({int(x) for x in (numbers if numbers is not None else []) if x >= 0})
                if left:
                    yield _rows(p, ((i, f) for i, f in _until(decoder(c).frames(), left[-1]) if i in set(left)))

    return blobs.select("path", "content", wanted).mapInPandas(run, PIXELS)


def decode_at(blobs: DataFrame, wanted: str, decoder: Callable[[bytes], object] = ArrayVideo) -> DataFrame:
    """PIXELS of the frame nearest each time in `wanted` (a column of arrays of seconds), the earlier of two equally near."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c, seconds in zip(b["path"], b["content"], b[wanted], strict=True):
                video = decoder(c)
                times = np.fromiter(video.times(), float)
                if len(times) and seconds is not None and len(seconds):
                    near = sorted({int(np.abs(times - s).argmin()) for s in seconds})
                    yield _rows(p, ((i, f) for i, f in _until(video.frames(), near[-1]) if i in set(near)))

    return blobs.select("path", "content", wanted).mapInPandas(run, PIXELS)


def _until(frames: Iterator[np.ndarray], last: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, f in enumerate(frames):
        yield i, f
        if i >= last:
            return


def _rows(path: str, found: Iterator[tuple[int, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([(path, i, f.shape[1], f.shape[0], np.ascontiguousarray(f, "u1").tobytes()) for i, f in found], columns=["path", "frame_index", "width", "height", "pixels"])
