"""Embedding near-dedup against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from lorespan.llm import caps
from tests.llm.conftest import groups


def brute(vectors, labels):
    n = len(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= caps.MIN_COSINE) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    return near.sum(axis=1), groups(n, [(i, j) for i, j in zip(*np.nonzero(np.triu(near)))]), near


@pytest.mark.parametrize("part", [20, 512])
def test_clusters_against_all_pairs(spark, part):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 64))
    rows = [c + rng.standard_normal((25, 64)) * s for c, s in zip(centres, np.linspace(0.05, 0.35, 12))]
    vectors = np.concatenate([*rows, rng.standard_normal((200, 64))]).astype(np.float32)
    vectors[40:45] = vectors[40]
    labels = [i % 2 if i < 100 else i // 300 for i in range(len(vectors))]
    df = spark.createDataFrame(
        [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(vectors, labels))],
        "vec_id long, embedding array<float>, label int",
    )
    got = {r.vec_id: r for r in caps.near_vectors(df, part=part).collect()}
    links, component, near = brute(vectors.astype(np.float64), labels)
    assert len(got) == len(vectors) and links.sum() > 1000
    mine = np.array([got[i].n_links for i in range(len(vectors))])
    assert (mine <= links).all() and mine.sum() >= 0.97 * links.sum()
    for i in range(len(vectors)):
        assert component[got[i].component_id] == component[i]
        assert got[i].kept == (got[i].component_id == i)
    same = [got[i].component_id == component[i] for i in range(len(vectors))]
    assert sum(same) >= 0.97 * len(same)
    again = {r.vec_id: r.n_links for r in caps.near_vectors(df, part=part + 3).collect()}
    assert again == {i: r.n_links for i, r in got.items()}  # parts do not change what is found


def test_decoding_lists_all_filters_over_the_threshold():
    rng = np.random.default_rng(2)
    unit = caps._units(rng.standard_normal((50, 64)))
    rotation, a, b = caps._code(64, 40, caps.SEED)
    turned = unit @ rotation
    scores = (turned[:, :32] @ a.T)[:, :, None] + (turned[:, 32:] @ b.T)[:, None, :]
    row, found = caps.decode(unit, 40, 2.5)
    for i in range(50):
        want = np.flatnonzero(scores[i].ravel() >= 2.5 / 8)
        got = found[row == i]
        assert got.tolist() == (want.tolist() or [scores[i].argmax()])


def test_recall_on_the_table(spark, root):
    df = spark.read.parquet(f"{root}/embeddings.parquet")
    rows = df.collect()
    vectors, labels = np.array([r.embedding for r in rows], np.float64), [r.label for r in rows]
    links, component, _ = brute(vectors, labels)
    got = {r.vec_id: r for r in caps.op9_embedding_near_dedup(spark, root).collect()}
    mine = np.array([got[r.vec_id].n_links for r in rows])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum()


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, v, 1, 0), (3, v, 1, 0), (3, v, 1, 0), (9, [2.0, 4.0, 6.0], 1, 0), (8, v, 2, 0), (1, v, None, 0), (2, w, 1, 0),
        (10, None, 1, 0), (11, [], 1, 0), (12, [0.0, 0.0, 0.0], 1, 0), (13, [nan, 1.0, 1.0], 1, 0), (14, [inf, 1.0, 1.0], 1, 0),
        (15, [1.0, None, 1.0], 1, 0), (None, v, 1, 0), (16, [1.0, 2.0], 1, 0), (17, [1e300, 2e300, 3e300], 1, 0),
        (18, [2.0], 1, 0), (19, [4.0], 1, 0), (20, [-4.0], 1, 0), (3, v, 2, 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n long")
    got = sorted((tuple(r) for r in caps.near_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 10, 11, 12, 13, 14, 15, 16, 20)] + [(None, 0, None, True)]
    near = [(3, 4, 3, True)] * 2 + [(5, 4, 3, False), (9, 4, 3, False), (17, 4, 3, False)]
    other = [(8, 1, 3, False), (3, 1, 3, True), (18, 1, 18, True), (19, 1, 18, False)]
    assert got == sorted(alone + near + other, key=str)
    assert caps.near_vectors(df.limit(0)).count() == 0
