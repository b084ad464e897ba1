"""Rollups by increments and event tables by day: repeated, late and dropped rows."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lorespan.sources import buckettable, eventstore as es
from lorespan.streaming import forms as f, rollups as ru

SHAPE = "event_id long, created_at timestamp, kind string, value double"
START = dt.datetime(2024, 1, 1)


def events(n=900, seed=5):
    rng = random.Random(seed)
    rows = [(i, START + dt.timedelta(minutes=rng.randrange(60 * 24 * 20)), rng.choice(["a", "b", None]), float(rng.randrange(50))) for i in range(n)]
    rows[3] = (3, None, "a", 1.0)
    rows[4] = (4, rows[4][1], "b", None)
    # A third of all rows on one day.
    return [(i, START + dt.timedelta(hours=i % 24), k, v) if i % 3 == 2 else (i, t, k, v) for i, t, k, v in rows]


def whole(spark, rows, unit="day"):
    return ru.partial(spark.createDataFrame(rows, SHAPE), ["kind"], {"v": "value"}, "created_at", unit)


def content(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_increments_equal_one_pass(spark, tmp_path):
    rows, path = events(), f"{tmp_path}/r"
    took = [ru.increment(spark.createDataFrame(rows[:n], SHAPE), path, "event_id", ["kind"], {"v": "value"}, buckets=4) for n in (300, 300, 650, 900)]
    assert took == [300, 0, 350, 250] and ru.mark(spark, path) == (3, 899)
    assert content(buckettable.read(spark, path)) == content(whole(spark, rows))
    # Stopped before the mark was written: the same increment once more.
    part = whole(spark, rows[650:])
    buckettable.fold(part, path, ru.folds(part.columns, ["kind"]), 3)
    assert content(buckettable.read(spark, path)) == content(whole(spark, rows))
    months = ru.report(spark, path, "month", ["kind"])
    assert content(months.drop("v_avg")) == content(whole(spark, rows, "month"))
    assert all(r.v_avg == pytest.approx(r.v_sum / r.v_n) for r in months.collect())
    with pytest.raises(ValueError):
        ru.increment(spark.createDataFrame([(None, START, "a", 1.0)], SHAPE), path, "event_id", ["kind"], {"v": "value"})


def test_stream_of_increments(spark, tmp_path):
    rows = events(400)
    source, path, seen = f"{tmp_path}/in", f"{tmp_path}/r", f"{tmp_path}/c"
    for n in (0, 200):
        spark.createDataFrame(rows[n : n + 200], SHAPE).coalesce(2).write.mode("append").parquet(source)
        stream = f.event_stream(spark, source, spark.read.parquet(source).schema, 1)
        ru.run_rollup(stream, path, seen, ["kind"], {"v": "value"}, "created_at", buckets=4)
        assert content(buckettable.read(spark, path)) == content(whole(spark, rows[: n + 200]))
    assert buckettable.version(spark, path) == 4


def files(path):
    return {os.path.join(d, x) for d, _, own in os.walk(f"{path}/data") for x in own if x.endswith(".parquet")}


def test_event_table(spark, tmp_path):
    rows, path = events(), f"{tmp_path}/e"
    df = spark.createDataFrame(rows, SHAPE)
    assert es.read(spark, path, df.schema).count() == 0 and es.days(spark, path) == []
    for n in (0, 1, 1):  # the second batch comes twice
        es.append(df.where(F.col("event_id") % 2 == n), path, n)
    stored = es.read(spark, path, df.schema)
    assert content(stored.drop("day")) == content(df) and len(es.days(spark, path)) == 20
    low, high = "2024-01-05 10:00:00", "2024-01-07"
    some = es.between(stored, low, high)
    want = df.where((F.col("created_at") >= low) & (F.col("created_at") < high))
    assert content(some.drop("day")) == content(want)
    assert {x.split("day=")[1][:10] for x in some.inputFiles()} >= {"2024-01-05"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    before = files(path)
    gone = es.retain(spark, path, "2024-01-20", 10)
    assert gone == [f"2024-01-{d:02d}" for d in range(1, 10)]
    assert files(path) == {x for x in before if not any(f"day={d}/" in x for d in gone)}  # nothing was rewritten
    es.append(df.where(F.col("event_id") % 2 == 0), path, 0)  # an old batch again
    kept = df.where("created_at is null or created_at >= '2024-01-10'")
    assert content(es.read(spark, path, df.schema).drop("day")) == content(kept)
    assert es.retain(spark, path, "2024-01-15", 10) == [] and es.horizon(spark, path) == dt.date(2024, 1, 10)
    with pytest.raises(ValueError):
        es.append(df.withColumn("day", F.lit(1)), path, 2)


def test_days_known_at_run_time_prune(spark, tmp_path):
    df, path = spark.createDataFrame(events(), SHAPE), f"{tmp_path}/e"
    es.append(df, path, 0)
    spark.createDataFrame([(dt.date(2024, 1, 4), "x"), (dt.date(2024, 1, 9), "y")], "on date, what string").write.parquet(f"{tmp_path}/c")
    calendar = spark.read.parquet(f"{tmp_path}/c").where("what = 'y'")
    joined = es.on_days(es.read(spark, path, df.schema), calendar, "on")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == df.where(F.to_date("created_at") == "2024-01-09").count() > 0
