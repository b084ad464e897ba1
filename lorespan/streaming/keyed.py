"""Keyed state with timers: sessions that expire when idle, and request limits decided per event.

State lies in RocksDB on the executors and is dropped by event-time timers, so it holds what is open and nothing else.
A key's rows of one trigger go to one task, as keyed state asks; they are folded in Arrow batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SESSION = "user_id long, first_activity long, last_activity long, events long, expired_at long"
_DECISION = "user_id long, event_id long, ts long, allowed boolean"


def _ms(micros: int) -> int:
    return -(-micros // 1000)


class _Timed(StatefulProcessor):
    """State as a list of rows, and one timer: the time at which the next row is due.

    Every question to the store is a round trip for each user, so none is asked whose answer is known: the rows held tell
    which timer stands, and a timer that has fired is gone afterwards.
    """

    SHAPE = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.SHAPE)

    def _keep(self, rows: list[tuple], due: int | None, standing: int | None = None) -> None:
        if standing is not None and standing != due:
            self.handle.deleteTimer(standing)
        if not rows:
            self.rows.clear()
            return
        self.rows.put(rows)
        if standing != due:
            self.handle.registerTimer(due)

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.rows.get()] if self.rows.exists() else []

    def close(self) -> None:
        pass


class _Idle(_Timed):
    """Open sessions of a user as ``first, last, events``, apart by at least the gap.

    They lie in one row, packed: the store takes and gives rows one by one.
    """

    SHAPE = "spans binary"

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def _held(self) -> list[tuple]:
        return [tuple(s) for r in super()._held() for s in np.frombuffer(r[0], dtype="<i8").reshape(-1, 3).tolist()]

    def _keep(self, rows: list[tuple], due: int | None, standing: int | None = None) -> None:
        super()._keep([(np.array(rows, dtype="<i8").tobytes(),)] if rows else [], due, standing)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = self._held()
        standing = _ms(spans[0][1] + self.gap) if spans else None
        for chunk in rows:
            t = np.sort(chunk["ts"].to_numpy(dtype="int64"))
            cut = np.flatnonzero(np.diff(t) >= self.gap) + 1
            spans += [(int(p[0]), int(p[-1]), len(p)) for p in np.split(t, cut)]
        merged: list[tuple] = []
        for first, last, n in sorted(spans):
            if merged and first < merged[-1][1] + self.gap:
                before = merged.pop()
                first, last, n = before[0], max(before[1], last), before[2] + n
            merged.append((first, last, n))
        self._keep(merged, _ms(merged[0][1] + self.gap), standing)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for s in self._held():
            (due if _ms(s[1] + self.gap) <= now else rest).append(s)
        self._keep(rest, _ms(rest[0][1] + self.gap) if rest else None)
        if due:
            out = [(key[0], first, last, n, last + self.gap) for first, last, n in due]
            yield pd.DataFrame(out, columns=["user_id", "first_activity", "last_activity", "events", "expired_at"])


class _Limit(_Timed):
    """Times of the requests that were let through, at most ``limit`` of them: older ones no longer count."""

    SHAPE = "at long"

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        at = deque(sorted(r[0] for r in self._held()))
        standing = _ms(at[-1] + self.window) if at else None
        allowed = np.zeros(len(came), dtype=bool)
        for i, t in enumerate(came["ts"].to_numpy(dtype="int64")):
            while at and at[0] <= t - self.window:
                at.popleft()
            if len(at) < self.limit:
                at.append(int(t))
                allowed[i] = True
        self._keep([(t,) for t in at], _ms(at[-1] + self.window), standing)
        yield came.assign(allowed=allowed)[["user_id", "event_id", "ts", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep([], None)
        return iter(())


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the queries started inside; a session that has it set stays as it is."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _micros(interval: str) -> int:
    """The length of an interval such as ``6 hours``, in microseconds."""
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


def _keyed(events: DataFrame, delay: str, processor: StatefulProcessor, shape: str, *columns: str) -> DataFrame:
    timed = events.where("user_id is not null and ts is not null").withWatermark("ts", delay)
    # The time itself carries the watermark; what Python reads is a number.
    rows = timed.select("user_id", F.col("ts").alias("_time"), F.unix_micros("ts").alias("ts"), *columns)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, shape, "Append", "EventTime")


def idle_sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions of users, given once when the watermark has passed their last event by ``gap``; then their state is gone.

    Events may come in any order within ``delay``: a session grows to both sides, and sessions that an event brings within
    the gap of each other become one. Events without a user or a time take no part.
    """
    out = _keyed(events, delay, _Idle(_micros(gap)), _SESSION)
    times = {c: F.timestamp_micros(c) for c in ("first_activity", "last_activity", "expired_at")}
    return out.withColumns(times)


def rate_limited(events: DataFrame, limit: int, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Every event with ``allowed``: fewer than ``limit`` allowed events of its user lie in the ``window`` before it.

    Events are decided in the order of triggers, and of time and id within one; the rows of a user in a trigger are held by
    one task, so bound the trigger. State has at most ``limit`` times per user, none once the window has passed.
    """
    out = _keyed(events, delay, _Limit(limit, _micros(window)), _DECISION, "event_id")
    return out.withColumn("ts", F.timestamp_micros("ts"))
