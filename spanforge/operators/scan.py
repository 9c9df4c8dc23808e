"""Joins of frames and intervals by one scan over both in order, without a range predicate."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordering import PART, dealt
from spanforge.sinks.writers import kept

ENDS = ("episode_index", "start_frame", "end_frame")


def scan_join(frames: DataFrame, intervals: DataFrame, first_by: list[str] | None = None, closed: bool = False, how: str = "inner") -> DataFrame:
    """frames' columns and those of the intervals (but ENDS) that hold each frame: of all of them, or of the first by the columns first_by (ascending; then the earlier start).

    frames: (episode_index, frame_index, ...); intervals: (ENDS, ...), up to and with end_frame if closed; the column names differ but for episode_index. Frames and both ends of the
    intervals are dealt out together in ranges of (episode, frame; at one frame starts, then frames, then ends), so a long episode is in several; an interval goes to each range from its start's to its
    end's, where those open at the range's beginning come in with it. A range is scanned once: what is open is carried from end to
    end, and frames between two ends have the same intervals. how: `left` keeps frames without any. Frames without number or episode are in no interval; intervals without ends hold none.
    """
    own = [c for c in intervals.columns if c not in ENDS]
    held = intervals.filter("episode_index is not null and start_frame is not null and end_frame is not null").withColumn("__id", F.monotonically_increasing_id())
    held = kept(held, "intervals")
    points = frames.select("episode_index", F.col("frame_index").cast("long").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__id"), F.struct(*frames.columns).alias("__f"))
    ends = held.select("episode_index", F.inline(F.array(*[F.struct(F.col(c).cast("long").alias("__at"), F.lit(side).alias("__side"), "__id", F.lit(None).cast(points.schema["__f"].dataType).alias("__f")) for c, side in zip(ENDS[1:], (0, 2), strict=True)])))
    both = dealt(points.unionByName(ends), [F.col("episode_index"), F.col("__at"), F.col("__side")], sort=False)
    spans = both.filter("__id is not null").groupBy("__id").agg(F.min(PART).alias("a"), F.max(PART).alias("b"))
    parts = spans.select("__id", F.explode(F.sequence("a", "b")).alias(PART))
    there = held.join(parts, "__id").drop("__id")
    points = both.filter("__f is not null").select(PART, "__f.*")
    named = frames.columns
    kinds = {f.name: f.dataType.simpleString() for f in [*frames.schema.fields, *intervals.schema.fields]}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*named, *own])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        rows, hits = matches(left, right, first_by, closed, how)
        cols = [left.column(c).take(pa.array(rows)) for c in named]
        hit = pa.array(hits, mask=hits < 0)
        return pa.table([*cols, *[right.column(c).take(hit) for c in own]], [*named, *own])

    return points.groupBy(PART).cogroup(there.groupBy(PART)).applyInArrow(scan, schema)


def matches(left: pa.Table, right: pa.Table, first_by: list[str] | None, closed: bool, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and the rows of right that hold them, -1 for none."""
    episode = pa.chunked_array([*left.column("episode_index").chunks, *right.column("episode_index").chunks], left.schema.field("episode_index").type)
    codes = pc.fill_null(episode.combine_chunks().dictionary_encode().indices, -1).to_numpy().astype("i8")
    code, of = codes[: left.num_rows], codes[left.num_rows :]
    number = lambda c: pc.fill_null(c.cast(pa.int64()), -1).to_numpy().astype("i8")
    at, start, end = number(left.column("frame_index")), number(right.column("start_frame")), number(right.column("end_frame"))
    valid = (code >= 0) & left.column("frame_index").is_valid().to_numpy()
    order = np.lexsort((at, code))
    order = order[valid[order]]
    low = int(at[order].min()) if len(order) else 0
    span = (int(at[order].max()) if len(order) else 0) - low + 2
    key = lambda c, x: c * span + np.clip(x - low, 0, span - 1)
    line = key(code[order], at[order])
    a, b = np.searchsorted(line, key(of, start)), np.searchsorted(line, key(of, end + 1 if closed else end))
    b = np.maximum(a, b)
    if first_by is None:
        size = b - a
        hits = np.repeat(np.arange(len(a)), size)
        rows = order[np.arange(len(hits)) + np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size)] if len(hits) else order[:0]
    else:
        rank = np.empty(len(a), "i8")
        rank[pc.sort_indices(right, [*[(c, "ascending") for c in first_by], ("start_frame", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(a))
        edges = np.unique(np.concatenate([a[b > a], b[b > a]]))
        begins = np.argsort(a, kind="stable")
        begins = begins[(b > a)[begins]]
        best, held, i = np.full(len(edges), -1), [], 0
        for k, edge in enumerate(edges):
            while i < len(begins) and a[begins[i]] <= edge:
                heapq.heappush(held, (rank[begins[i]], begins[i]))
                i += 1
            while held and b[held[0][1]] <= edge:
                heapq.heappop(held)
            best[k] = held[0][1] if held else -1
        place = np.searchsorted(edges, np.arange(len(order)), side="right") - 1
        found = np.where(place >= 0, best[np.maximum(place, 0)], -1) if len(edges) else np.full(len(order), -1)
        rows, hits = order[found >= 0], found[found >= 0]
    if how == "left":
        none = np.ones(left.num_rows, bool)
        none[rows] = False
        rows, hits = np.concatenate([rows, np.flatnonzero(none)]), np.concatenate([hits, np.full(int(none.sum()), -1)])
    return rows.astype("i8"), hits.astype("i8")
