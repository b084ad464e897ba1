"""Searches of the whole embeddings table against itself have no limit on the query side."""

from __future__ import annotations

import pytest

from lorespan.operators import retrieve as r
from lorespan.plans import load

ENTRIES = load()
ALL_PAIRS = [
    "search_cosine", "search_inner_product", "search_l2", "search_l1", "search_threshold", "search_range", "search_with_filter",
    "similarity_pairs", "precision_at_5", "format_results", "mmr_relevance_only", "mmr_search", "ranking_metrics", "mean_ranking_metrics",
]


@pytest.mark.parametrize("name", ALL_PAIRS)
def test_more_vectors_than_can_be_broadcast(spark, root, monkeypatch, name):
    monkeypatch.setattr(r, "BROADCAST_ROWS", 10)
    text = ENTRIES[name].run(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and "MapInArrow" not in text.replace("CoGroupsInArrow", "")


def test_memories_have_no_limit_on_the_query_side(spark, root, monkeypatch):
    monkeypatch.setattr(r, "BROADCAST_ROWS", 2)
    assert ENTRIES["search_memory"].run(spark, root).count() > 0


def test_links_of_copies_and_of_vectors_that_cannot_be_compared(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.1], [0.0, 0.0], [0.0, 0.0], [-1.0, 0.0], None, [1.0, None]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for rows in (None, 1, 2):
        got = {x["vec_id"]: (x["class_id"], x["n_links"]) for x in r.similarity_links(df, 0.9, block_rows=rows).collect()}
        assert got == {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (3, 0), 4: (3, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0)}, rows


def test_distances_of_copies_are_exact(spark):
    v = [0.1 * i + 1 / 3 for i in range(64)]
    df = spark.createDataFrame([(0, v), (1, v), (2, [x + 1e-7 for x in v])], "vec_id long, embedding array<double>")
    for metric, apart in (("l2", 8e-7), ("l1", 64e-7)):
        hits = r.search(df.withColumnRenamed("vec_id", "query_id"), df, 3, metric=metric, plan="blocks").where("query_id = 0")
        got = {x["vec_id"]: x["score"] for x in hits.collect()}
        assert got[0] == got[1] == 1.0 and abs(got[2] - 1 / (1 + apart)) <= 1e-9


EVERY_VECTOR_ASKS = [
    "search_memory", "search_cosine", "search_inner_product", "search_l2", "search_l1", "search_blocks", "search_with_filter",
    "precision_at_5", "format_results", "mmr_relevance_only", "ranking_metrics",
]


@pytest.mark.parametrize("name", EVERY_VECTOR_ASKS)
def test_every_vector_asks(spark, root, name):
    vectors = {x["vec_id"] for x in spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id").collect()}
    assert {x["query_id"] for x in ENTRIES[name].run(spark, root).select("query_id").collect()} == vectors


@pytest.mark.parametrize("name", ["search_threshold", "search_range"])
def test_vectors_with_near_ones_ask(spark, root, name):
    assert any(x["query_id"] % 50 for x in ENTRIES[name].run(spark, root).select("query_id").collect())


@pytest.mark.parametrize("name", ["search_lsh_recall", "mean_ranking_metrics"])
def test_every_vector_counts_as_query(spark, root, name):
    assert ENTRIES[name].run(spark, root).first()["queries"] == spark.read.parquet(f"{root}/embeddings.parquet").count()


def test_pairs_are_emitted(spark, root):
    pairs = ENTRIES["similarity_pairs"].run(spark, root)
    links = r.similarity_links(spark.read.parquet(f"{root}/embeddings.parquet"), 0.25).agg({"n_links": "sum"}).first()[0]
    assert pairs.columns == ["left", "right", "score"] and pairs.where("left < right").count() == links / 2 > 0
