"""The Merkle manifest against a tree in memory."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from lorespan.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root, and per node the siblings before and after, by levels."""
    proofs, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(of):
            first = at // 16 * 16
            proofs[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        of = [at // 16 for at in of]
    return nodes[0], proofs


def forest(rows):
    """Of (id, source, leaf) rows, in their order: subroot, root, proof."""
    groups = {}
    for k, (i, s, leaf) in enumerate(rows):
        groups.setdefault(s, []).append(((i is not None, i or 0), leaf, k))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = [], []
    for s in names:
        own = sorted(groups[s])
        top, proofs = tree([leaf for _, leaf, _ in own])
        subroots.append(top)
        inner.append([(k, p) for (_, _, k), p in zip(own, proofs)])
    root, outer = tree(subroots)
    out = {}
    for top, own, above in zip(subroots, inner, outer):
        out |= {k: (top, root, p + above) for k, p in own}
    return [out[k] for k in range(len(rows))]


def of_rows(spark, rows):
    df = spark.createDataFrame([(k, i, s, leaf, "x") for k, (i, s, leaf) in enumerate(rows)], "k int, doc_id long, source string, leaf string, idx string")
    return {r.k: (r.subroot, r.root, [tuple(p) for p in r.proof]) for r in merkle.manifest(df).collect()}


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [257, 1, 16, 33], [4096], [4097, 5, 1, 300], [1] * 20, [70_000, 3]])
def test_forests(spark, sizes):
    rng = random.Random(len(sizes))
    names = [None, "é", "z", "Z", ""] + [f"s{k}" for k in range(30)]
    rows = [(rng.randrange(10**12) * 1000 + k, names[g], sha(str(g), str(k))) for g, n in enumerate(sizes) for k in range(n)]
    rng.shuffle(rows)
    got, want = of_rows(spark, rows), forest(rows)
    assert got == dict(enumerate(want))


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a", sha("x")), (1, "a", sha("x")), (1, "a", sha("b")), (None, "a", sha("n")), (None, None, sha("m"))] + [(k, "a", sha(str(k))) for k in range(20)]
    got, want = of_rows(spark, rows), forest(rows)
    assert all(got[k][:2] == w[:2] for k, w in enumerate(want)) and got[3] == want[3]
    assert sorted(got[k][2] for k in (0, 1)) == sorted(want[k][2] for k in (0, 1))
    df = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.manifest(df).count() == 0


def test_leaf_fields(spark):
    long = "aé" * 200_000
    rows = [(1, "s", "en", 3, "Aé\n"), (None, None, None, None, None), (2, "", "", 0, ""), (-5, "s", "en", 10**12, long)]
    df = spark.createDataFrame(rows, "a long, b string, c string, d long, e string")
    got = [r[0] for r in df.select(merkle.leaf_digest(*map(df.__getitem__, "abcde"))).collect()]
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert got == [sha(*map(text, r)) for r in rows]


def test_whole_table(spark, root):
    docs = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaves = [sha(*map(text, r)) for r in docs]
    want = {}
    for r, leaf, (subroot, root_, proof) in zip(docs, leaves, forest([(r[0], r[1], leaf) for r, leaf in zip(docs, leaves)])):
        acc = sha(*map(text, r[:4]), text(low(r[4]))) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
        for before, after in proof:
            acc = sha(before, acc, after)
        want[r[0]] = (leaf, subroot, root_, sha(*[x + y for x, y in proof]), acc, acc == root_)
    got = {r.doc_id: tuple(r)[1:] for r in merkle.op11_merkle_manifest(spark, root).collect()}
    assert got == want and {v[-1] for v in got.values()} == {True, False}
