"""The index of projection buckets against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.operators import annindex, retrieve


def vectors(spark, root):
    e = spark.read.parquet(f"{root}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("query_id"), "embedding"), e


def test_recall_and_scores(spark, root, tmp_path):
    queries, corpus = vectors(spark, root)
    path = f"{tmp_path}/index"
    annindex.build(corpus, path)
    exact = retrieve.search(queries, corpus, 10, exclude_self=True, plan="blocks")
    found = annindex.search(queries, path, 10, exclude_self=True)
    row = annindex.recall(found, exact).first()
    assert row.recall >= 0.9 and row.scores_equal and row.queries == queries.count()
    few = annindex.recall(annindex.search(queries, path, 10, 1, exclude_self=True), exact).first()
    assert few.recall < row.recall  # the index is read again; fewer probes find less
    small = annindex.search(queries, path, 10, exclude_self=True, block_rows=60)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, found.collect()))


def test_near_copies_are_always_found(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 24))
    near = base + 0.01 * rng.standard_normal(base.shape)
    corpus = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(near)], "query_id long, embedding array<double>")
    annindex.build(corpus, f"{tmp_path}/x", tables=4, bits=8)
    assert all(r.query_id == r.vec_id for r in annindex.search(queries, f"{tmp_path}/x", 1, 4).collect())


def test_added_rows_and_odd_ones(spark, tmp_path):
    path = f"{tmp_path}/x"
    shape = "vec_id string, embedding array<float>, k int"
    one = spark.createDataFrame([("a", [1.0, 0.0], 1), ("n", None, 1), ("h", [1.0, None], 1), ("z", [0.0, 0.0], 1)], shape)
    annindex.build(one, path, tables=2, bits=2)
    before = {r.id for r in spark.read.parquet(f"{path}/rows").collect()}
    annindex.add(spark.createDataFrame([("b", [0.9, 0.1], 1), ("b2", [-1.0, 0.0], 1)], shape), path)
    queries = spark.createDataFrame([("q", [1.0, 0.05]), ("none", None)], "query_id string, embedding array<float>")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in annindex.search(queries, path, 5, 4).orderBy("rank").collect()]
    assert before == {"a", "z"} and [x[:2] for x in got] == [("q", "a"), ("q", "b"), ("q", "z"), ("q", "b2")]
    assert annindex.search(queries.limit(0), path).count() == 0
    annindex.build(one.limit(0), f"{tmp_path}/empty")
    assert annindex.search(queries, f"{tmp_path}/empty").count() == 0
    with pytest.raises(ValueError):
        annindex.build(one, path, bits=17)
    with pytest.raises(ValueError):
        annindex.search(queries, path, 0)


def test_probes_begin_with_the_own_bucket_and_differ():
    rng = np.random.default_rng(3)
    planes = annindex.Planes(annindex._planes(16, 3, 5, 1), rng.standard_normal(15) * 0.1, 3)
    units = rng.standard_normal((40, 16))
    probes = planes.probes(units, 7)
    assert (probes[:, :, 0] == planes.buckets(units)).all()
    assert all(len(set(p)) == 7 for row in probes.tolist() for p in row)
