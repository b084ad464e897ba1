"""Near copies against Jaccard similarity of all pairs."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from lorespan.llm import shingles as shingle_sets
from tests.llm.conftest import groups


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_against_all_pairs(spark, root):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    hot = [word() for _ in range(30)]
    texts = []
    for n, changed in ((50, 1), (100, 1), (100, 2), (200, 4), (500, 10), (60, 5), (200, 12)):
        for _ in range(5):
            base = [word() for _ in range(n)] + hot
            texts.append(" ".join(base))
            for _ in range(3):
                for k in rng.sample(range(n), changed):
                    base[k] = word()
                texts.append(" ".join(base))
    sets = [shingles(t) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    part = groups(len(texts), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, root).collect()}
    assert len(near) > 30 and got == {k for k, top in part.items() if k == top}


def test_rows_of_equal_or_missing_id(spark, root):
    one, two = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, one), (1, one), (1, two), (None, one), (None, two), (None, "s t u"), (2, None), (3, ""), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, root).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (None, "s t u"), (2, None), (4, "x")], key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), root).count() == 0


def test_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{k % 9000}" for k in range(60_000))
    rows = [(4, long, 1, 2), (3, long + " more", 5, 6), (9, "x" * 200_000, 7, 8), (2, None, 9, 10), (2, None, 9, 10), (5, " \n", 11, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, k int")
    got = shingle_sets.first_of_each_group(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[3], rows[1], rows[2]]


def test_a_passage_that_most_share_joins_nothing(spark, monkeypatch):
    """With a frequent passage in every document, results are the same and the passage is not posted."""
    monkeypatch.setattr(shingle_sets, "SAMPLE_DOCS", 40)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(50))
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(100)) + " " + passage for _ in range(80)]
    texts += [t.replace("w1", "w2", 1) for t in texts[:10]] + [passage, passage + " end"]
    sets = [shingles(t) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in shingle_sets.first_of_each_group(docs).collect()}
    assert got == {k for k, top in groups(len(texts), near).items() if k == top} and len(got) < len(texts)
    frequent, rank = shingle_sets.frequent_shingles(docs.select(F.xxhash64("text").alias("k"), F.col("text").cast("binary").alias("t")), 5)
    assert len(frequent) >= 46 and sorted(rank.tolist()) == list(range(len(frequent)))
