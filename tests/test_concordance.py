"""Kendall's tau-b against its definition over all pairs of rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lorespan.operators import profile as pr
from lorespan.operators.concordance import inversions, kendall


def tau(x, y):
    """By comparing every two rows."""
    kept = [(a, b) for a, b in zip(x, y) if a is not None and b is not None and not math.isnan(a) and not math.isnan(b)]
    sign = lambda v: (v > 0) - (v < 0)
    s = tx = ty = 0
    for i, (a, b) in enumerate(kept):
        for c, d in kept[:i]:
            s += sign(a - c) * sign(b - d)
            tx += a != c
            ty += b != d
    return round(s / math.sqrt(tx) / math.sqrt(ty), 6) if tx and ty else None


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 257])
def test_inversions(n):
    rng = np.random.default_rng(n)
    rank, weight = rng.permutation(n), rng.integers(1, 5, n).astype(float)
    want = sum(weight[i] * weight[j] for j in range(n) for i in range(j) if rank[i] > rank[j])
    assert inversions(rank, weight) == want


def draw(kind, n=400):
    rng = random.Random(kind)
    x = [rng.gauss(0, 1) for _ in range(n)]
    if kind == "related":
        y = [v + rng.gauss(0, 1) for v in x]
    elif kind == "against":
        y = [-v for v in x]
    elif kind == "hot":  # one value of x and one of y hold a third of all rows, and rows repeat
        x = [0.5 if i % 3 == 0 else round(v, 1) for i, v in enumerate(x)]
        y = [2.0 if i % 3 == 1 else float(rng.randrange(8)) for i in range(n)]
    else:
        x = [rng.choice([None, math.nan, -0.0, 0.0, 1.0, 2.5, -math.inf, math.inf]) for _ in range(n)]
        y = [rng.choice([None, math.nan, -0.0, 0.0, 7.0]) for _ in range(n)]
    return x, y


@pytest.mark.parametrize("points", [20, 100_000])
@pytest.mark.parametrize("kind", ["related", "against", "hot", "odd"])
def test_tau(spark, kind, points):
    x, y = draw(kind)
    z = [float(i % 5) for i in range(len(x))]
    df = spark.createDataFrame(list(zip(x, y, z)), "x double, y double, z double")
    if kind == "odd":  # an infinite difference has a sign all the same, but for equal infinities
        x = [None if v is None else max(min(v, 1e9), -1e9) if not math.isnan(v) else v for v in x]
    got = {(r.left, r.right): r.correlation for r in kendall(df, ["x", "y", "z"], points=points).collect()}
    assert got == {("x", "y"): tau(x, y), ("x", "z"): tau(x, z), ("y", "z"): tau(y, z)}


def test_nothing_to_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "x double, y double, z double")
    assert {r.correlation for r in pr.correlation(df, "kendall").collect()} == {None}
    assert [r.correlation for r in pr.correlation(df.limit(0).select("x", "y"), "kendall").collect()] == [None]
    assert pr.correlation(df.select("x"), "kendall").collect() == []
