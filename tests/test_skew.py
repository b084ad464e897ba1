"""Windows over hot keys equal plain windows, and no task needs a whole key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from lorespan.operators import skew


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows belong to one key, one key is null."""
    rnd = random.Random(3)
    rows, seen = [], set()
    for i in range(4000):
        key = "hot" if i % 2 else rnd.choice(["a", "b", None])
        turn = rnd.randrange(100_000)
        if (key, turn) not in seen:
            seen.add((key, turn))
            rows.append((key, turn, rnd.randrange(50)))
    return spark.createDataFrame(rows, "k string, turn long, v long").cache()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_position_and_sums(hot):
    got = skew.prefix_sums(
        hot, ["k"], ["turn"], skew.width_bucket("turn", 512), {"pos": F.lit(1), "s": F.col("v")}, {"total": "s"}
    )
    w = Window.partitionBy("k").orderBy("turn")
    want = hot.select(
        "*",
        F.row_number().over(w).alias("pos"),
        F.sum("v").over(w).alias("s"),
        F.sum("v").over(Window.partitionBy("k")).alias("total"),
    )
    cols = ("k", "turn", "pos", "s", "total")
    assert rows(got, *cols) == rows(want, *cols)


def test_without_keys(hot):
    one = hot.groupBy("turn").agg(F.sum("v").alias("v"))
    got = skew.position(one, [], ["turn"], skew.width_bucket("turn", 4096))
    assert sorted(r["pos"] for r in got.collect()) == list(range(1, one.count() + 1))


def test_previous_value(hot):
    got = skew.previous_value(hot, ["k"], ["turn"], skew.width_bucket("turn", 64), "v", "before")
    want = hot.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("turn")))
    assert rows(got, "k", "turn", "before") == rows(want, "k", "turn", "before")


@pytest.mark.parametrize("n,width", [(3, 4), (10, 64), (7, 2)])
def test_previous_rows(hot, n, width):
    numbered = skew.position(hot.where("k is not null"), ["k"], ["turn"], skew.width_bucket("turn", 512))
    got = skew.previous_rows(numbered, ["k"], "pos", n, F.col("v"), "before", width)
    frame = Window.partitionBy("k").orderBy("turn").rowsBetween(-n, -1)
    want = hot.where("k is not null").withColumn("before", F.collect_list("v").over(frame))
    assert rows(got, "k", "turn", "before") == rows(want, "k", "turn", "before")


def test_buckets_never_decrease(spark):
    values = [-1e12, -5.5, -1.0, -1e-7, 0.0, 1e-9, 0.3, 1.0, 2.5, 1e3, 1e3 + 1, 1e300]
    got = skew.with_value_bucket(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    ordered = [r[skew.VALUE_BUCKET] for r in got.orderBy("v").collect()]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("value", ["1.7e9 + id", "id / 1e9", "(1.7e9 + id / 1e3) * 1e6", "-pow(id, 3)"])
def test_buckets_split_any_range(spark, value):
    df = spark.range(100_000).selectExpr(f"{value} as v")
    sizes = [r["count"] for r in skew.with_value_bucket(df, "v").groupBy(skew.VALUE_BUCKET).count().collect()]
    assert len(sizes) > 500 and max(sizes) < 1_000


@pytest.mark.parametrize("n", [1, 2, 5, 1001])
def test_exact_quantiles(spark, n):
    import statistics

    rnd = random.Random(n)
    data = [rnd.choice([0.0, rnd.gauss(0, 1e3), rnd.random(), 7.0]) for _ in range(n)]
    df = spark.createDataFrame([("x", v) for v in data] + [("y", None)], "k string, v double")
    got = {r["k"]: r for r in skew.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 1.0], ["lo", "mid", "hi"]).collect()}
    assert set(got) == {"x"}
    assert got["x"]["lo"] == min(data) and got["x"]["hi"] == max(data)
    assert got["x"]["mid"] == pytest.approx(statistics.median(data))


def test_hot_key_is_cut(hot):
    """The largest group that one window sees is a bucket, not the key."""
    cells = hot.groupBy("k", skew.width_bucket("turn", 512)).count()
    assert cells.agg(F.max("count")).first()[0] < hot.where("k = 'hot'").count() / 50
    plan = skew.position(hot, ["k"], ["turn"], skew.width_bucket("turn", 512))._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan.split("Window")[0]
