"""Decontamination against a plain Smith-Waterman over whole documents."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.dataset as ds

from lorespan.llm import decontaminate as de


def plain_alignment(item, words):
    """Best local alignment score by the textbook recursion."""
    best, above = 0, [0] * (len(words) + 1)
    for a in item:
        here = [0]
        for j, b in enumerate(words, 1):
            here.append(max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, here[j - 1] - 1))
        best, above = max(best, *here), here
    return best


def test_alignment_of_many_pairs():
    rng = np.random.default_rng(1)
    items = [rng.integers(1, 9, rng.integers(1, 12)) for _ in range(60)]
    passages = [rng.integers(1, 9, rng.integers(1, 25)) for _ in range(60)]
    best, end = de.align(de._padded(items, -1), de._padded(passages, -2))
    for i, p, b, e in zip(items, passages, best, end):
        assert b == plain_alignment(i.tolist(), p.tolist())
        assert plain_alignment(i.tolist(), p[: e + 1].tolist()) == b


def edited(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out += [f"new{rng.randint(0, 999)}"] if x < 2 * share / 3 else [w, "more"] if x < share else [w]
    return out


def test_copies_and_edited_copies(spark, root):
    rng = random.Random(4)
    items = ds.dataset(f"{root}/benchmark.parquet").to_table().to_pylist()
    corpus = ds.dataset(f"{root}/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
    rows, want = [], {}
    for k, item in enumerate(items):
        around = rng.choice(corpus)[:2000]
        words = edited(de.words_of(item["text"]), rng, 0.15 if k % 2 else 0)
        rows.append((k, around + "\n" + " ".join(words).upper() + ".\n" + around))
        score = plain_alignment(de.words_of(item["text"]), de.words_of(rows[-1][1])) / 2 / len(de.words_of(item["text"]))
        want[k, item["item_id"]] = score
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in de.contaminated(docs, spark.read.parquet(f"{root}/benchmark.parquet")).collect()}
    for key, score in want.items():
        if score >= de.MIN_SCORE:
            assert abs(got[key].score - score) < 0.03
            words = de.words_of(rows[key[0]][1])[got[key].first_word : got[key].last_word + 1]
            own = de.words_of(items[key[0]]["text"])
            assert plain_alignment(own, words) / 2 / len(own) == got[key].score
    assert sum(s >= de.MIN_SCORE for s in want.values()) > 0.9 * len(want)


def test_whole_table_against_brute_force(spark, root):
    items = ds.dataset(f"{root}/benchmark.parquet").to_table().to_pylist()
    docs = ds.dataset(f"{root}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    got = {(r.doc_id, r.item_id) for r in de.op10_benchmark_decontamination(spark, root).collect()}
    words = {d["doc_id"]: de.words_of(d["text"])[:3000] for d in docs}
    padded = de._padded([np.array([hash(w) for w in words[d["doc_id"]]], dtype=np.int64) for d in docs], -2)
    want = set()
    for item in items:
        own = np.array([hash(w) for w in de.words_of(item["text"])], dtype=np.int64)
        best, _ = de.align(np.repeat(own[None, :], len(docs), axis=0), padded)
        want |= {(d["doc_id"], item["item_id"]) for d, b in zip(docs, best) if b / 2 / len(own) >= de.MIN_SCORE}
    assert got == want and want


def test_blocks_of_items_give_the_same(spark, root):
    docs, bench = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(tuple, de.contaminated(docs, bench, block_words=n).collect())) for n in (10**6, 500))
    assert one == many and one


def test_odd_rows(spark):
    long = "x y z " * 20_000
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, None, 1), (2, "", 1), (None, f"a {item} b", 1), (3, long + item, 1), (3, long + item, 1), (4, "solo word", 1)]
    items = [(7, item, 1.0), (7, item, 1.0), (8, None, 0.0), (9, "", 0.0), (None, "solo word", 0.0), (10, "word solo", 0.0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id int, text string, score double")
    got = sorted((str(r.doc_id), str(r.item_id), r.score) for r in de.contaminated(docs, bench).collect())
    assert got == [("3", "7", 1.0)] * 4 + [("4", "None", 1.0)] + [("None", "7", 1.0)] * 2
    assert de.contaminated(docs.limit(0), bench).count() == de.contaminated(docs, bench.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in de.without_leaks(docs, bench).collect()) == ["1", "2"]
