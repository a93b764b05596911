"""Event logs as streams: counts in time windows, gaps and early stops by typed state of each case, with timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..spec import LogSpec


def timed(stream: DataFrame, spec: LogSpec, late: str) -> DataFrame:
    """Zoneless times can't carry a watermark, so they are cast first."""
    return stream.withColumn(spec.time, F.col(spec.time).cast("timestamp")).withWatermark(spec.time, late)


def window_counts(stream: DataFrame, spec: LogSpec, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event, n of tumbling (or sliding) windows; state older than the watermark goes."""
    at = F.window(spec.time, width, slide) if slide else F.window(spec.time, width)
    return timed(stream, spec, late).groupBy(at.alias("w"), spec.event).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), spec.event, "n")


class Gaps(StatefulProcessor):
    """Seconds since the case's event before, told at once. State: the latest time seen, in microseconds,
    which goes ``idle_ms`` after it by a timer."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def _keep(self, last: int, watermark_ms: int) -> None:
        self.last.update((last,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(last // 1000, watermark_ms) + self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        events = pd.concat(list(rows)).sort_values(["us", "tie"])
        out, last = _counted(key[0], events[["us", "tie"]].itertuples(index=False), last)
        self._keep(last, max(timerValues.getCurrentWatermarkInMs(), 0))
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class OrderedGaps(Gaps):
    """The same of events in the order of their times: those of a case wait in a list until the watermark
    has passed them, so an event that comes late, but not too late, has the gap that a batch gives it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "us bigint, tie bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        self.waiting.appendList([(int(us), int(tie)) for us, tie in events[["us", "tie"]].itertuples(index=False)])
        for ms in {int(us) // 1000 + 1 for us in events["us"]}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get())
        ready, rest = [e for e in events if e[0] < passed], [e for e in events if e[0] >= passed]
        if rest:
            self.waiting.put(rest)
        elif events:
            self.waiting.clear()
        last = self.last.get()[0] if self.last.exists() else None
        if ready:
            out, last = _counted(key[0], ready, last)
            self.last.update((last,))
            self.handle.registerTimer(max(last // 1000, passed // 1000) + self.idle_ms)
            yield out
        elif last is not None and not rest and last // 1000 + self.idle_ms <= passed // 1000:
            self.last.clear()


def _counted(case: object, events: Iterable[tuple[int, int]], last: int | None) -> tuple[pd.DataFrame, int]:
    out = []
    for us, tie in events:
        if last is not None:
            out.append((case, int(tie), max(int(us) - last, 0) / 1e6))
        last = int(us) if last is None else max(last, int(us))
    return pd.DataFrame(out, columns=["case", "tie", "gap_s"]), last


class EarlyStops(StatefulProcessor):
    """Whether a run stops at each epoch: its least loss so far, epochs since that, and the verdict."""

    def __init__(self, patience: int, delta: float) -> None:
        self.patience, self.delta = patience, delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "best double, stale bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        best, stale = self.told.get() if self.told.exists() else (None, 0)
        out = []
        for epoch, loss in pd.concat(list(rows)).sort_values("epoch")[["epoch", "loss"]].itertuples(index=False):
            better = best is None or loss < best - self.delta
            stale = 0 if better else stale + 1
            best = loss if best is None else min(best, loss)
            out.append((key[0], int(epoch), float(best), int(stale), stale >= self.patience))
        self.told.update((float(best), int(stale)))
        yield pd.DataFrame(out, columns=["run", "epoch", "best", "stale", "stop"])

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame) -> None:
    """Typed state and timers live in RocksDB; a session that has Spark's default store is switched to it."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if "RocksDB" not in stream.sparkSession.conf.get(key):
        stream.sparkSession.conf.set(key, rocks)


def gaps(stream: DataFrame, spec: LogSpec, late: str = "10 minutes", idle_ms: int = 3_600_000, *, ordered: bool = False) -> DataFrame:
    """case, tie, gap_s: seconds since the case's event before.

    Events of a batch are put in order, and each is told at once; one that comes later than its
    successor counts from the latest time seen, as 0. ``ordered``: events wait until the watermark
    passes them, and have the gaps of a batch over all but what came later than ``late``. A
    case's state goes ``idle_ms`` after its last event.
    """
    _stateful(stream)
    case = stream.schema[spec.case].dataType.simpleString()
    rows = timed(stream, spec, late).select(F.col(spec.case).alias("case"), F.col(spec.tie).cast("bigint").alias("tie"), F.unix_micros(spec.time).alias("us"), spec.time)
    processor = OrderedGaps(idle_ms) if ordered else Gaps(idle_ms)
    return rows.groupBy("case").transformWithStateInPandas(processor, f"case {case}, tie bigint, gap_s double", "Append", "EventTime")


def early_stops(stream: DataFrame, run: str, epoch: str, loss: str, patience: int, delta: float = 0.0) -> DataFrame:
    """run, epoch, best, stale and stop of each epoch, as ``sequences.early_stop`` has them, of histories
    whose epochs come in order (within a batch they may not)."""
    _stateful(stream)
    kind = stream.schema[run].dataType.simpleString()
    rows = stream.select(F.col(run).alias("run"), F.col(epoch).cast("bigint").alias("epoch"), F.col(loss).cast("double").alias("loss"))
    return rows.groupBy("run").transformWithStateInPandas(EarlyStops(patience, delta), f"run {kind}, epoch bigint, best double, stale bigint, stop boolean", "Append", "None")
