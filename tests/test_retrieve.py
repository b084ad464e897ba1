"""Retrieval against brute force, on both paths."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.operators import rankeval, retrieve as r, vectors as v

RND = np.random.default_rng(5)
Q = RND.normal(size=(13, 6)).round(3)
C = np.vstack([RND.normal(size=(200, 6)).round(3), np.zeros((1, 6)), Q[:2], Q[:2]])


@pytest.fixture(scope="module")
def sides(spark):
    q = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(Q)], "query_id long, embedding array<double>")
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(C)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    c = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return q, c


def brute(metric):
    if metric == "cosine":
        n = np.linalg.norm(C, axis=1)
        s = (Q @ C.T) / np.linalg.norm(Q, axis=1)[:, None] / np.where(n == 0, 1, n)
    elif metric == "ip":
        s = Q @ C.T
    elif metric == "l2":
        s = 1 / (1 + np.linalg.norm(Q[:, None] - C[None], axis=2))
    else:
        s = 1 / (1 + np.abs(Q[:, None] - C[None]).sum(2))
    return np.round(s, 9)


@pytest.mark.parametrize("metric", r.METRICS)
@pytest.mark.parametrize("opts", [{}, {"plan": "blocks", "block_rows": 40}], ids=["broadcast", "blocks"])
def test_search(sides, metric, opts):
    got = r.search(*sides, 4, metric=metric, **opts).collect()
    s = brute(metric)
    want = {
        (i, rank + 1): (int(j), s[i, j])
        for i in range(len(Q))
        for rank, j in enumerate(sorted(range(len(C)), key=lambda j: (-s[i, j], j))[:4])
    }
    assert len(got) == len(want)
    for row in got:
        j, score = want[(row["query_id"], row["rank"])]
        assert row["vec_id"] == j and row["score"] == pytest.approx(score, abs=2e-9)


@pytest.mark.parametrize("opts", [{}, {"plan": "blocks", "block_rows": 50}], ids=["broadcast", "blocks"])
def test_range_keeps_every_hit(sides, opts):
    got = {(x["query_id"], x["vec_id"]) for x in r.range_search(*sides, 0.2, **opts).collect()}
    s = brute("cosine")
    assert got == {(i, j) for i in range(len(Q)) for j in range(len(C)) if s[i, j] >= 0.2}


def test_k_larger_than_the_corpus(sides):
    q, c = sides
    assert r.search(q, c.where("vec_id < 3"), 10).count() == 3 * len(Q)


def test_wrong_arguments(sides):
    with pytest.raises(ValueError, match="unknown metric"):
        r.search(*sides, metric="hamming")
    with pytest.raises(ValueError, match="give k or min_score"):
        r.search(*sides, None)


def test_hybrid_equals_brute_force(spark):
    texts = ["red apple", "red red car", "blue sky", "green apple pie", "", "apple"]
    q = v.hashed_embedding(spark.createDataFrame([(0, "red apple tree"), (1, "sky")], "query_id long, text string"), dimension=16)
    c = v.hashed_embedding(spark.createDataFrame(list(enumerate(texts)), "vec_id long, text string"), dimension=16)
    qs, cs = {x["query_id"]: x for x in q.collect()}, {x["vec_id"]: x for x in c.collect()}
    for opts in ({}, {"plan": "blocks", "block_rows": 2}):
        got = {(x["query_id"], x["vec_id"]): x["score"] for x in r.hybrid_search(q, c, 6, 0.3, **opts).collect()}
        assert len(got) == 12
        for (i, j), score in got.items():
            a, b = np.array(qs[i]["embedding"]), np.array(cs[j]["embedding"])
            words = set(qs[i]["text"].split())
            keyword = len(words & set(cs[j]["text"].split())) / len(words)
            assert score == pytest.approx(0.3 * float(a @ b) + 0.7 * keyword, abs=1e-8)
    assert rows(r.hybrid_search(q, c, 3, 1.0)) == rows(r.search(q, c, 3))


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_mmr_prefers_the_different_one(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame(
        [(1, [0.9, 0.1, 0.0]), (2, [0.9, 0.11, 0.0]), (3, [0.6, -0.6, 0.4]), (4, [0.0, 0.0, 1.0])],
        "vec_id long, embedding array<double>",
    )
    ids = lambda df: [x["vec_id"] for x in df.orderBy("rank").collect()]
    assert ids(r.mmr_search(q, c, 2, 4, 0.3)) == [1, 4]
    assert ids(r.mmr_search(q, c, 2, 4, 1.0)) == [1, 2]
    assert ids(r.mmr_search(q, c, 6, 4, 0.5)).__len__() == 4


def test_rerank_with_a_scorer(spark):
    hits = spark.createDataFrame(
        [(0, "a", "aa", 1, 0.5), (0, "a", "bbb", 2, 0.4), (0, "a", "c", 3, 0.3)],
        "query_id long, query_text string, text string, vec_id long, score double",
    )
    longest = lambda qs, ts: [len(x) for x in ts]
    got = r.rerank(hits, 2, longest).orderBy("rank").collect()
    assert [(x["vec_id"], x["rerank_score"]) for x in got] == [(2, 3.0), (1, 2.0)]


def test_user_encoder(spark):
    df = spark.createDataFrame([("ab",), ("",)], "text string")
    got = v.embed(df, lambda ts: np.array([[len(x), 0.0] for x in ts])).collect()
    assert [x["embedding"] for x in got] == [[1.0, 0.0], [0.0, 0.0]]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        v.cosine_similarity(a, b), v.euclidean_distance(a, b), v.manhattan_distance(a, b), v.dot_product(a, b), v.normalize_vector(a)
    ).collect()
    assert got[0][0] == pytest.approx(0.96) and got[0][1] == pytest.approx(2**0.5) and tuple(got[0][2:4]) == (2.0, 24.0)
    assert got[0][4] == [0.6, 0.8] and got[1][0] == 0.0 and got[1][4] == [0.0, 0.0]


def test_validate_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([float("nan"), 1.0],)], "embedding array<double>")
    assert [x["valid"] for x in v.validate_vectors(df, 2).collect()] == [True, False, False, False]


def test_ranking_metrics_by_hand(spark):
    runs = spark.createDataFrame(
        [("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, "c"), ("q2", 1, "z")], "query_id string, rank long, doc_id string"
    )
    qrels = spark.createDataFrame([("q1", "b", 2.0), ("q1", "c", 1.0), ("q1", "d", 1.0)], "query_id string, doc_id string, grade double")
    got = {x["query_id"]: x for x in rankeval.ranking_metrics(rankeval.judge(runs, qrels), qrels, 5).collect()}
    one = got["q1"]
    assert (one["precision"], one["recall"], one["f1"], one["hit_rate"]) == (0.6667, 0.6667, 0.6667, 1.0)
    assert one["reciprocal_rank"] == 0.5 and one["average_precision"] == round((1 / 2 + 2 / 3) / 3, 4)
    dcg, ideal = 2 / np.log2(3) + 1 / 2, 2 + 1 / np.log2(3)
    assert one["dcg"] == round(dcg, 4) and one["ndcg"] == round(dcg / ideal, 4)
    two = got["q2"]
    assert all(two[m] == 0.0 for m in ("precision", "recall", "f1", "hit_rate", "reciprocal_rank", "ndcg", "average_precision"))


def test_recall_grows_with_k(spark, root):
    e = spark.read.parquet(f"{root}/embeddings.parquet")
    hits = r.search(e.withColumnRenamed("vec_id", "query_id"), e, 20, exclude_self=True)
    counts = hits.select("query_id").distinct().withColumn("relevant", F.lit(49))
    judged = hits.withColumn("grade", (F.col("vec_id") % 10 == F.col("query_id") % 10).cast("double"))
    means = [rankeval.ranking_metrics(judged, counts, k).agg(F.avg("recall")).first()[0] for k in (1, 5, 20)]
    assert means == sorted(means)


def test_bleu_and_rouge_by_hand(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the the cat sat on mat"), (2, "a b", "")], "i int, ref string, cand string")
    got = {x["i"]: x for x in rankeval.rouge(df, "ref", "cand", ["i"]).collect()}
    assert (got[1]["rouge1"], got[1]["rouge2"]) == (1.0, 0.6) and got[2]["rouge1"] == 0.0
    same = spark.createDataFrame([("a b c d e", "a b c d e")], "ref string, cand string")
    assert rankeval.bleu(same, "ref", "cand").first()["bleu"] == 1.0


def test_longest_common_subsequence(spark):
    import random

    rng = random.Random(4)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]) for _ in range(150)]

    def plain(a, b):
        cells = [0] * (len(b) + 1)
        for x in a:
            last = list(cells)
            for j, y in enumerate(b, 1):
                cells[j] = last[j - 1] + 1 if x == y else max(last[j], cells[j - 1])
        return cells[-1]

    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", rankeval.longest_common(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == plain(r.a, r.b) for r in got)
    df = spark.createDataFrame([(1, "the cat sat down", "the cat quietly sat"), (2, "", "x"), (3, None, "x")], "i int, ref string, cand string")
    assert {r.i: (r.common, r.rougeL) for r in rankeval.rouge_l(df, "ref", "cand", ["i"]).collect()} == {1: (3, 0.75), 2: (0, 0.0), 3: (None, None)}
