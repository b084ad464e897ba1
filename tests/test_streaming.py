"""Streaming forms over several micro-batches equal their batch twins."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorespan.sources.tables import table
from lorespan.streaming import forms as f


@pytest.fixture(scope="module")
def days(spark, root, tmp_path_factory):
    """The events as one file per five days, read one file per batch."""
    path = str(tmp_path_factory.mktemp("days"))
    events = table(spark, root, "events")
    for start in range(1, 32, 5):
        part = events.where((F.dayofmonth("ts") >= start) & (F.dayofmonth("ts") < start + 5))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, events


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_update_mode_equals_batch(spark, days):
    path, events = days
    stream = f.event_stream(spark, path, events.schema, 1)
    got = f.collect_available(f.usage_windows(stream), "update", ("start", "end", "event_type"))
    assert rows(got.drop("duration")) == rows(f.usage_windows(events).drop("duration"))


def test_append_mode_equals_closed_groups(spark, days):
    path, events = days
    got = f.collect_available(f.user_sessions(f.event_stream(spark, path, events.schema, 1)), "append")
    closed = events.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    # Compared in Python: a filter on a session's end would be pushed below the merging of its events.
    at_end = sorted(got.columns).index("end")
    assert rows(got) == [r for r in rows(f.user_sessions(events)) if r[at_end] <= closed]


def test_alerts_grow_over_batches(spark, days):
    path, events = days
    stream = f.event_stream(spark, path, events.schema, 1)
    got = f.collect_available(f.failed_login_alerts(stream, 1), "update", ("user_id", "day"))
    assert rows(got) == rows(f.failed_login_alerts(events, 1))


def test_restart_appends_nothing_twice(spark, days, tmp_path):
    path, events = days
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        f.run_append(f.event_stream(spark, path, events.schema, 2), out, checkpoint)
    assert spark.read.parquet(out).count() == events.count()


def test_default_limits(spark):
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, i % 60)) for i in range(51)], "user_id long, ts timestamp")
    assert f.rate_violations(e, "1 hour").count() == 1 and f.rate_violations(e, "1 day").count() == 0
