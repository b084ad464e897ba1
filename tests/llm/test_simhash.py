"""SimHash near-dedup against a direct reading of its definition."""

from __future__ import annotations

import random
from itertools import combinations

import pyarrow.dataset as ds
import xxhash

from lorespan.llm import common, simhash
from tests.llm.conftest import groups


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered:
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_every_four_positions_hold_a_posting():
    assert len(simhash.POSTINGS) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.POSTINGS)


def test_whole_table_against_brute_force(spark, root):
    rows = ds.dataset(f"{root}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    prints = [plain_print(r["text"]) for r in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    part = groups(len(rows), near)
    want = {(r["doc_id"], f"{prints[i]:016x}", rows[part[i]]["doc_id"]) for i, r in enumerate(rows)}
    got = simhash.op7_simhash_near_dedup(spark, root).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_links_are_complete_with_short_and_long_lists(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base[:6]:
        for _ in range(40):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            prints.add(x)
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {
        (min(a, b), max(a, b))
        for a, b in combinations(prints, 2)
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    }
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    for long_list in (10_000, 3):
        got = simhash.linked_pairs(df, long_list=long_list).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_odd_rows(spark):
    text = "One two THREE four five six seven eight"
    rows = [(5, None, 1), (3, "", 1), (None, "\t\n", 1), (9, text, 1), (9, text, 1), (7, text.upper(), 1), (2, "Äb", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    same, other = f"{plain_print(text):016x}", f"{plain_print('Äb'):016x}"
    zero = "0" * 16
    want = [(5, zero, 3), (3, zero, 3), (None, zero, 3), (9, same, 7), (9, same, 7), (7, same, 7), (2, other, 2)]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_text():
    words = [f"w{i % 977}" for i in range(70_000)]
    assert int(simhash.fingerprints_of([" ".join(words).encode()])[0]) % 2**64 == plain_print(" ".join(words))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(common.components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert common.components(spark.createDataFrame([], "a int, b int")).count() == 0
