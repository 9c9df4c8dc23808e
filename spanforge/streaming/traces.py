"""Traces of sessions as streaming state: one handle per session, closed when its session falls idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: kind: `step`, `late` (a step that isn't after the last one of its trace: marked, changes nothing), `closed` (the trace's last row, when its session fell idle).
COLUMNS = "kind string, sample_id long, step_id long, memory_in string, memory_out string, started timestamp, samples string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


class Trace(StatefulProcessor):
    """Memory and steps of a session's open trace.

    A step idle_ms or more after the last one closes the trace and opens another, whatever trigger they come in; a timer closes
    it when time itself has passed that point. keep_ms: how long state may live without a write (processing time only).
    """

    def __init__(self, initial: str, idle_ms: int, by_event_time: bool, keep_ms: int | None = None) -> None:
        self.initial, self.idle_ms, self.by_event_time, self.keep_ms = initial, idle_ms, by_event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.by_event_time else self.keep_ms
        self.open = handle.getValueState("open", "memory string, started long, last long, sample long, steps long, timer long", ttl)
        self.steps = handle.getListState("steps", "sample long", ttl)

    def _close(self, key: tuple, state: tuple) -> tuple:
        samples = ",".join(str(s[0]) for s in self.steps.get())
        self.open.clear()
        self.steps.clear()
        return (*key, "closed", None, state[4], None, state[0], state[1], samples)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get() if self.open.exists() else None
        timer, out, fresh = (state[5] if state else None), [], []
        new = pd.concat(list(rows)).sort_values(["at", "sample_id"])
        now = new["at"] if self.by_event_time else [timerValues.getCurrentProcessingTimeInMs()] * len(new)
        for at, sample, pred, skip, reset in zip(now, new["sample_id"], new["pred"], new["skip"], new["reset_memory"], strict=True):
            at, sample = int(at), int(sample)
            if state and at - state[2] >= self.idle_ms:
                if fresh:
                    self.steps.appendList(fresh)
                out.append(self._close(key, state))
                state, fresh = None, []
            if state and sample <= state[3]:
                out.append((*key, "late", sample, None, None, None, state[1], None))
                continue
            memory = self.initial if reset or not state else state[0]
            said = (pred.strip() if isinstance(pred, str) and not skip else "") or memory
            state = (said, state[1] if state else at, at, sample, (state[4] if state else 0) + 1, None)
            out.append((*key, "step", sample, state[4], memory, said, state[1], None))
            fresh.append((sample,))
        if fresh:
            self.steps.appendList(fresh)
        if timer is not None and (not state or timer != state[2] + self.idle_ms):
            self.handle.deleteTimer(timer)
        if state and timer != state[2] + self.idle_ms:
            self.handle.registerTimer(state[2] + self.idle_ms)
        if state:
            self.open.update((*state[:5], state[2] + self.idle_ms))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and (state := self.open.get())[5] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._rows(key, [self._close(key, state)])

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(out, columns=["session", *NAMES])
        table["started"] = pd.to_datetime(table["started"].astype("int64"), unit="ms", utc=True)
        return table.astype({"sample_id": "Int64", "step_id": "Int64"})


def _clean(rows: DataFrame) -> DataFrame:
    reset = F.coalesce("reset_memory", F.lit(False)) if "reset_memory" in rows.columns else F.lit(False)
    return rows.select("session", "ts", F.unix_millis("ts").alias("at"), F.col("sample_id").cast("long").alias("sample_id"), "pred", F.coalesce("skip", F.lit(False)).alias("skip"), reset.alias("reset_memory"))


def follow(rows: DataFrame, initial: str, idle_ms: int, late: str | None, keep_ms: int | None = None) -> DataFrame:
    """(session, COLUMNS) of a stream of (session, ts, sample_id, pred, skip[, reset_memory]).

    Each step gets the memory that it begins with and the one that it leaves; a closed trace says how many steps it had, and which. late: how much
    later than others a step may come by event time, by which sessions fall idle then; None: by the clock. Steps of one trigger are taken in order of time and sample_id.
    Needs a state store of several column families; see `runs.finish`.
    """
    kind = rows.schema["session"].dataType.simpleString()
    rows = _clean(rows)
    if late is not None:
        rows = rows.withWatermark("ts", late)
    processor = Trace(initial, idle_ms, late is not None, keep_ms)
    return rows.groupBy("session").transformWithStateInPandas(processor, f"session {kind}, {COLUMNS}", "append", "ProcessingTime" if late is None else "EventTime")


def replay(rows: DataFrame, initial: str, idle_ms: int, until_ms: int) -> DataFrame:
    """The same rows from a table, where time has come to until_ms: traces that another follows, or that are idle by then, are closed. Steps are taken in order of time; none is late."""
    each = Window.partitionBy("session").orderBy("at", "sample_id")
    gap = F.col("at") - F.lag("at").over(each)
    steps = _clean(rows).withColumn("opens", F.coalesce(gap >= idle_ms, F.lit(True)))
    steps = steps.withColumn("started", F.max(F.when(F.col("opens"), F.col("at"))).over(each.rowsBetween(Window.unboundedPreceding, 0)))
    trace = Window.partitionBy("session", "started").orderBy("at", "sample_id")
    steps = steps.withColumns({"step_id": F.row_number().over(trace).cast("long"), "part": F.sum(F.col("reset_memory").cast("int")).over(trace.rowsBetween(Window.unboundedPreceding, 0))})
    said = F.when(~F.col("skip"), F.nullif(F.trim("pred"), F.lit("")))
    before = Window.partitionBy("session", "started", "part").orderBy("step_id").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("said", said).withColumn("memory_in", F.coalesce(F.last("said", ignorenulls=True).over(before), F.lit(initial)))
    steps = steps.withColumn("memory_out", F.coalesce("said", "memory_in"))
    closed = steps.groupBy("session", "started").agg(
        F.count(F.lit(1)).alias("step_id"), F.max_by("memory_out", "step_id").alias("memory_out"), F.max("at").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "sample_id"))), lambda s: s["sample_id"].cast("string")), ",").alias("samples"),
    )
    followed = F.col("started") < F.max("started").over(Window.partitionBy("session"))
    closed = closed.withColumn("followed", followed).filter(F.col("followed") | (F.col("last") + idle_ms < until_ms)).select("session", F.lit("closed").alias("kind"), F.lit(None).cast("long").alias("sample_id"), "step_id", F.lit(None).cast("string").alias("memory_in"), "memory_out", "started", "samples")
    steps = steps.select("session", F.lit("step").alias("kind"), "sample_id", "step_id", "memory_in", "memory_out", "started", F.lit(None).cast("string").alias("samples"))
    return steps.unionByName(closed).withColumn("started", F.timestamp_millis("started"))
