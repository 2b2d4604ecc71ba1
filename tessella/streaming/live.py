"""Structured Streaming forms: usage trend, stall detection, failure lockout, incremental work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.tasks import LOCKED, FailureWindow


def usage_trend(usage: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, module, tokens, calls) of a stream (ts, module, tokens_in, tokens_out), a day at a time, with a watermark."""
    day = F.window("ts", "1 day")
    used = usage.where(F.col("tokens_in") + F.col("tokens_out") > 0).withWatermark("ts", late)
    return used.groupBy(day.alias("w"), "module").agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.count("*").alias("calls")).select(F.to_date("w.start").alias("day"), "module", "tokens", "calls")


def stalls(beats: DataFrame, minutes: int = 5) -> DataFrame:
    """(task_id, last_beat): tasks whose heartbeats (task_id, ts, status) stop for so long in event time; a final status ends the watch.

    State is one timestamp for each running task.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "last_beat": [pd.Timestamp(last, unit="ms")]})
            return
        last, over = (state.get[0] if state.exists else 0), False
        for b in batches:
            last = max(last, int(b["ts"].max().timestamp() * 1000))
            over = over or b["status"].isin(["completed", "failed", "cancelled"]).any()
        if over:
            if state.exists:
                state.remove()
            return
        state.update((last,))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    timed = beats.withWatermark("ts", "1 second")
    return timed.groupBy("task_id").applyInPandasWithState(watch, "task_id long, last_beat timestamp", "last long", "append", "EventTimeTimeout")


class _Lockouts(StatefulProcessor):
    """Failures wait until the watermark has passed them and are then taken in order of time; a timer closes the window.

    State of a key: its waiting failures, and its window (started, failures, locked until).
    """

    def __init__(self, most: int, window: int, lock: int):
        self.most, self.window, self.lock = most, window, lock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long")
        self.held = handle.getValueState("held", "started long, failures long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [int(t) for part in rows for t in part["t"]]
        self.waiting.appendList([(t,) for t in times])
        for t in sorted({-(-t // 1000) for t in times}):
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        ripe, later = [t for t in waiting if t <= now], [t for t in waiting if t > now]
        if ripe:
            self.waiting.put([(t,) for t in later]) if later else self.waiting.clear()
        at = FailureWindow(*self.held.get()) if self.held.exists() else None
        done = []
        for t in [*ripe, None]:  # and what the watermark itself has ended
            if at is not None and at.over(now if t is None else t, self.window):
                if at.locked_until:
                    done.append((key[0], pd.Timestamp(at.started, unit="us"), at.failures, pd.Timestamp(at.locked_until, unit="us")))
                at = None
            if t is not None:
                at = at or FailureWindow(t)
                at.fail(t, self.most, self.lock)
        if at is None:
            self.held.clear()
        else:
            self.held.update((at.started, at.failures, at.locked_until))
            self.handle.registerTimer(-(-max(at.locked_until, at.started + self.window) // 1000))
        if done:
            yield pd.DataFrame(done, columns=["key", "window_start", "failures", "locked_until"])

    def close(self) -> None:
        pass


def lockouts(failures: DataFrame, most: int = 5, minutes: int = 15, lock_minutes: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, window_start, failures, locked_until) of a stream of failures (key, ts): the rows of `tasks.lockouts`, each once its window is over.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Failures later than
    the watermark are dropped.
    """
    window, lock = minutes * 60_000_000, (minutes if lock_minutes is None else lock_minutes) * 60_000_000
    timed = failures.where("key IS NOT NULL").withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    kind = failures.schema["key"].dataType.simpleString()
    return timed.groupBy("key").transformWithStateInPandas(_Lockouts(most, window, lock), f"key {kind}, {LOCKED}", "Append", "EventTime")


def incremental(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> DataStreamWriter:
    """Work on new rows only; a batch that is run again overwrites its own folder, so the sink holds each result once."""

    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
