"""Packing: every id once, no sequence over its capacity, few sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest

from lorespan.llm import packing
from lorespan.llm.tokens import encoder


def best_by_search(lengths, capacity):
    """Fewest bins by trying all placements (small cases)."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in sorted(set(bins)):
            if k + lengths[i] <= capacity:
                go(i + 1, [*bins[: bins.index(k)], k + lengths[i], *bins[bins.index(k) + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_near_the_best(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(12)]
    patterns, bound = packing.plan(dict(Counter(lengths)), 20, rounds=40)
    n = sum(k for _, k in patterns)
    best = best_by_search(lengths, 20)
    assert bound <= best + 1e-6 and best <= n <= best + 1
    used = Counter()
    for pattern, k in patterns:
        assert sum(pattern) <= 20
        for length in pattern:
            used[length] += k
    assert used == Counter(lengths)


def test_knapsack_by_recursion():
    price = np.array([-1, -1, -1, 0.3, -1, 0.62, -1, 0.8, -1, -1, -1, -1])
    value, last = packing._knapsack(price)

    def best(c):
        return max([0, *(price[l] + best(c - l) for l in range(1, c + 1) if price[l] > 0)])

    assert np.allclose(value, [best(c) for c in range(12)])


def test_many_equal_lengths_follow_the_program():
    histogram = {700: 30_000, 648: 15_000, 1024: 10_000, 500: 8_000, 48: 2_000, 2048: 500}
    patterns, bound = packing.plan(histogram)
    n = sum(k for _, k in patterns)
    assert bound <= n <= bound * 1.003 + 2


def test_all_documents(spark, root):
    rows = packing.op2_best_fit_packing(spark, root).collect()
    texts = ds.dataset(f"{root}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    lib = encoder("word_bpe_49k.json").lib
    want, total = [], 0
    for r in texts:
        ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, i in enumerate(range(0, len(ids), 2048)):
            own = ids[i : i + 2048]
            want.append((r["doc_id"], k, i, len(own), zlib.crc32(own.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    check_places(rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 2


def check_places(rows):
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_odd_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (None, "a b", 2), (3, "", 3), (4, "x " * 5000, 4), (4, "x " * 5000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = packing.packed_documents(docs).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in got) == sorted(
        [("1", 0, 1)] * 2 + [("None", 0, 3), ("3", 0, 1)] + [("4", 0, 2048), ("4", 1, 2048), ("4", 2, 905)] * 2
    )
    check_places(got)
    assert packing.packed_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(3000,)], "length long"))
