"""Tables in buckets: what a change writes, and what a repeated one does."""

from __future__ import annotations

import os
import random

from lorespan.sources import buckettable as bt


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, own in os.walk(f"{path}/data") for f in own if f.endswith(".parquet")}


def content(spark, path, at=None):
    return sorted((tuple(r) for r in bt.read(spark, path, at).collect()), key=str)


SHAPE = "k long, g string, t long, v string"


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(k, "a", 0, f"v{k}") for k in range(500)] + [(None, "a", 0, "none")]
    bt.create(spark.createDataFrame(rows, SHAPE), path, ["k"], 16)
    before = files(path)
    changes = spark.createDataFrame([(3, "b", 1, "new"), (None, "b", 1, "new none"), (900, "b", 1, "added")], SHAPE)
    assert bt.upsert(changes, path) == 1
    want = {r[0]: r for r in rows} | {3: (3, "b", 1, "new"), None: (None, "b", 1, "new none"), 900: (900, "b", 1, "added")}
    assert content(spark, path) == sorted(want.values(), key=str) and content(spark, path, 0) == sorted(rows, key=str)
    after = files(path)
    assert {f: after[f] for f in before} == before and 1 <= len(set(after) - set(before)) <= 3
    bt.delete(spark.createDataFrame([(k,) for k in range(500)], "k long"), path)
    assert {r[0] for r in content(spark, path)} == {None, 900}
    bt.delete(spark.createDataFrame([(None,), (900,)], "k long"), path)
    assert content(spark, path) == [] and len(content(spark, path, 1)) == 502


def test_newest_wins_and_repeats_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    rng = random.Random(2)
    rows = [(rng.randrange(40), "a", t, f"v{t}") for t in range(400)]
    rng.shuffle(rows)
    bt.create(spark.createDataFrame([], SHAPE), path, ["k"], 8)
    newest = {}
    for n in range(4):
        batch = rows[100 * n : 100 * n + 100]
        for r in batch:
            newest[r[0]] = max(newest.get(r[0], r), r, key=lambda x: x[2])
        for _ in range(2 if n in (1, 3) else 1):  # repeated after a failure
            bt.upsert(spark.createDataFrame(batch, SHAPE), path, ["t"], n + 1)
        assert content(spark, path) == sorted(newest.values(), key=str) and bt.version(spark, path) == n + 1
