"""Hard negatives against scores of all pairs in Python integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, angles int"


def plain(rows, positives=5, hard=10):
    """Of (id, vector, label) rows: all result rows, sorted."""
    able = [
        (k, i, [math.floor(256 * x) for x in v], lab)
        for k, (i, v, lab) in enumerate(rows)
        if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, i, q, lab in able:
        if i % 100:
            continue
        scored = [(-sum(map(int.__mul__, q, r)), j, other) for m, j, r, other in able if m != k and len(r) == len(q)]
        for s, j, _ in sorted((s, j, o) for s, j, o in scored if o == lab)[:positives]:
            fit = sorted((t, n) for t, n, o in scored if o != lab and -30 * s <= -100 * t <= -90 * s)[:hard]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine_negatives(df, F.col("id") % 100 == 0).collect())


def of(rng, centre, spread):
    return [float(np.float32(c + rng.gauss(0, spread))) for c in centre]


def test_clusters_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "SPAN", 8)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(k, of(rng, rng.choice(centres), rng.choice((0.05, 0.4))), rng.randrange(4)) for k in range(900)]
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(40)]  # ties
    rows += [(100, rows[7][1], 1), rows[200], (None, rows[0][1], 1), (2000, None, 1), (2100, rows[1][1], None), (2200, [], 1), (2201, [], 1)]
    rows += [(2300, [1.0] * 3, 2), (2301, [0.5] * 3, 2), (2302, [0.3] * 3, 0), (2400, [0.0] * 12, 1), (2500, [float("nan")] * 12, 1), (2600, [None] * 12, 1)]
    want = plain(rows)
    assert mined(spark, rows) == want and len(want) > 300


def test_bounds_hold():
    rng = np.random.default_rng(8)
    whole = np.floor(256 * rng.standard_normal((600, 9)) * rng.choice([0, 0.01, 1, 50], (600, 1)))
    norm, angles = negatives.angles_to(whole, negatives.fitted_directions(whole[:50], 6))
    order, starts = negatives._windows(np.zeros(600, int), angles, 10)
    low, high = np.minimum.reduceat(angles[order], starts), np.maximum.reduceat(angles[order], starts)
    least, most = np.minimum.reduceat(norm[order], starts), np.maximum.reduceat(norm[order], starts)
    lower, upper = negatives.score_bounds(norm, angles, low, high, least, most)
    scores = whole @ whole[order].T
    assert (np.minimum.reduceat(scores, starts, axis=1) >= lower).all() and (np.maximum.reduceat(scores, starts, axis=1) <= upper).all()
    assert (upper - lower).mean() < 0.9 * 2 * np.outer(norm, most).mean()


def test_empty_and_too_large(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_whole_table(spark, root):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{root}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, root).collect())
    assert got == plain(rows) and got
