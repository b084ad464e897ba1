"""Merged sketches against exact counts and ranks."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorespan.operators import sketches as sk


def rows(spark, n=20_000):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(hours=rng.randrange(24 * 40)), rng.choice("abc"), rng.randrange(5000), rng.expovariate(0.01)) for _ in range(n)]
    data += [(start, "d", None, None), (None, "a", 7, 1.0)]
    return spark.createDataFrame(data, "created_at timestamp, model string, user_id long, ms double")


def sketch(df, unit="hour"):
    return sk.summarise(df, ["model"], unit=unit, distinct={"users": "user_id"}, quantiles={"ms": "ms"})


def test_any_period_within_the_error(spark, tmp_path):
    df = rows(spark)
    sketch(df).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    for low, high in ((0, 40), (3, 17), (20, 21)):
        inside = lambda c: (F.col(c) >= F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=low))) & (F.col(c) < F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=high)))  # noqa: B023, E731
        got = {r.model: r for r in sk.report(sk.roll_up(stored.where(inside("period")), ["model"])).collect()}
        exact = df.where(inside("created_at")).groupBy("model").agg(F.count_distinct("user_id").alias("u"), F.count("*").alias("n"), F.collect_list("ms").alias("ms"))
        for r in exact.collect():
            mine = got[r.model]
            assert mine["rows"] == r.n and abs(mine.users - r.u) <= 0.02 * r.u
            for p, name in ((0.5, "ms_p50"), (0.95, "ms_p95"), (0.99, "ms_p99")):
                if r.ms:
                    below = sum(v < mine[name] for v in r.ms) / len(r.ms), sum(v <= mine[name] for v in r.ms) / len(r.ms)
                    assert below[0] - 0.02 <= p <= below[1] + 0.02 and mine[name] in r.ms
                else:
                    assert mine[name] is None and mine.users == 0


def test_merge_is_the_whole(spark):
    df = rows(spark, 3000)
    parts = [sketch(df.where(F.pmod(F.hash("user_id"), F.lit(3)) == k)) for k in range(3)]
    whole = {(r.period, r.model): (r["rows"], r.users) for r in sk.report(sketch(df)).collect()}
    for order in ((0, 1, 2), (2, 0, 1)):
        got = {(r.period, r.model): (r["rows"], r.users) for r in sk.report(sk.merge(*[parts[k] for k in order])).collect()}
        assert got == whole  # sets of a few dozen are exact
    months = sk.report(sk.roll_up(sketch(df), [], "month"), [0.5])
    assert months.columns == ["period", "rows", "users", "ms_p50"] and sum(r["rows"] for r in months.collect()) == df.count()


def test_empty_and_wrong_units(spark):
    df = rows(spark, 1).limit(0)
    assert sk.report(sketch(df)).count() == 0 and sk.merge(sketch(df), sketch(df)).count() == 0
    with pytest.raises(ValueError):
        sketch(df, "minute")
    with pytest.raises(ValueError):
        sk.roll_up(sketch(df), [], "decade")
