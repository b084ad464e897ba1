"""Keyed state over several triggers: sessions equal their batch form, limits a plain loop, and no state is left."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespan.session import scratch_path
from lorespan.streaming import forms as f, keyed

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOUR = dt.timedelta(hours=1)
SHAPE = "event_id long, user_id long, ts timestamp"


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """Five files, one trigger each; times within a file are in no order, and a user has a third of all events."""
    rng, path, rows = random.Random(8), str(tmp_path_factory.mktemp("keyed")), []
    for part in range(5):
        own = [(part * 90 + i, 1 if i % 3 == 0 else rng.randrange(2, 9), START + HOUR * (40 * part) + dt.timedelta(seconds=rng.randrange(144_000))) for i in range(90)]
        if part == 2:
            own += [(9001, None, START + 90 * HOUR), (9002, 3, None)]
        spark.createDataFrame(own, SHAPE).coalesce(1).write.mode("append").parquet(path)
        rows += own
    # The end: a far event moves the watermark past every session.
    spark.createDataFrame([(9999, 99, START + 1000 * HOUR)], SHAPE).coalesce(1).write.mode("append").parquet(path)
    return path, [r for r in rows if r[1] is not None and r[2] is not None]


def run(spark, path, form):
    events = f.event_stream(spark, path, spark.read.parquet(path).schema, 1)
    seen, out = scratch_path(spark, "checkpoint"), scratch_path(spark, "out")
    made = form(events)
    with keyed.rocks(spark):
        f.run_append(made, out, seen, 2)
    state = spark.read.format("statestore").option("stateVarName", "rows").option("flattenCollectionTypes", True).load(seen)
    return spark.read.schema(made.schema).parquet(out).collect(), {r.key.user_id for r in state.collect()}


def test_sessions_by_timer(spark, batches):
    path, rows = batches
    got, state = run(spark, path, lambda e: keyed.idle_sessions(e, "5 hours", "41 hours"))
    want = []
    for user in {r[1] for r in rows}:
        own = sorted(r[2] for r in rows if r[1] == user)
        for t in own:
            if want and want[-1][0] == user and t - want[-1][2] < 5 * HOUR:
                want[-1] = (user, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((user, t, t, 1))
    aware = lambda t: t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t
    micros = {r[2].timestamp() for r in rows}
    assert {aware(r.first_activity.astimezone(dt.timezone.utc)).timestamp() for r in got} <= micros
    mine = sorted((r.user_id, r.first_activity.timestamp(), r.last_activity.timestamp(), r.events) for r in got)
    assert mine == sorted((u, a.timestamp(), b.timestamp(), n) for u, a, b, n in want)
    assert state == {99}  # what is open, and nothing else


def test_limits(spark, batches):
    path, rows = batches
    got, state = run(spark, path, lambda e: keyed.rate_limited(e, 4, "10 hours", "41 hours"))
    want, let = {}, {}
    for part in range(5):
        for i, user, t in sorted((r for r in rows if r[0] // 90 == part), key=lambda r: (r[2], r[0])):
            let[user] = [x for x in let.get(user, []) if x > t - 10 * HOUR]
            want[i] = len(let[user]) < 4
            if want[i]:
                let[user].append(t)
    mine = {r.event_id: r.allowed for r in got}
    assert mine.pop(9999) and mine == want and 0 < sum(want.values()) < len(want)
    assert state == {99}


class Store:
    """A user's state and timers, with the questions that were asked."""

    def __init__(self):
        self.kept, self.timers, self.asked = [], [], []

    def __getattr__(self, name):
        def ask(*args):
            self.asked.append(name)
            if name == "put":
                self.kept = list(args[0])
            elif name == "clear":
                self.kept = []
            elif name == "registerTimer":
                self.timers.append(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            return {"getListState": self, "exists": bool(self.kept), "get": iter(self.kept), "listTimers": iter(self.timers)}.get(name)

        return ask


def test_idle_sessions_ask_the_store_little():
    store, idle = Store(), keyed._Idle(10_000)
    idle.init(store)
    came = lambda *t: list(idle.handleInputRows((7,), iter([pd.DataFrame({"ts": t})]), None))
    came(*range(0, 800_000, 20_000))
    assert store.asked == ["getListState", "exists", "put", "registerTimer"] and len(store.kept) == 1 and store.timers == [10]
    came(785_000, 5_000)  # the first session is open longer, so its timer moves
    assert store.asked[4:] == ["exists", "get", "deleteTimer", "put", "registerTimer"] and store.timers == [15]
    came(900_000)  # the timer stays
    assert store.asked[9:] == ["exists", "get", "put"] and store.timers == [15]
    watermark = type("Values", (), {"getCurrentWatermarkInMs": lambda self: 800})()
    (out,) = idle.handleExpiredTimer((7,), watermark, None)
    want = [(7, 0, 5_000, 2, 15_000)] + [(7, t, t, 1, t + 10_000) for t in range(20_000, 780_000, 20_000)] + [(7, 780_000, 785_000, 2, 795_000)]
    assert list(out.itertuples(index=False, name=None)) == want
    assert "listTimers" not in store.asked and idle._held() == [(900_000, 900_000, 1)] and store.timers == [15, 910]
