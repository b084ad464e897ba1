"""Near-duplicate documents by SimHash, searched through an inverted index of fingerprint bytes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import Scratch, arrow_step, components, keyed, stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Members of a posting list beyond which it is read by one byte more.
LONG_LIST = 2_000

_LANES = np.uint64(0x0101010101010101)


def _posting_positions() -> list[tuple[int, int, int]]:
    """The 20 triples of the 8 byte positions of which every four positions contain one.

    Positions lie in three groups; a triple is taken if it lies in one group, or has two positions in a group and one
    in the next.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for triple in combinations(range(8), 3):
        n = [sum(group[p] == g for p in triple) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            found.append(triple)
    return found


POSTINGS = _posting_positions()
#: For each set of equal bytes (as a bit mask), the first triple within it.
_FIRST = [
    next((i for i, t in enumerate(POSTINGS) if all(mask >> p & 1 for p in t)), -1) for mask in range(256)
]


def fingerprints_of(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text as int64 (the bits of the unsigned value)."""
    hashes: list[int] = []
    ends = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split() if text else []
        if len(words) <= width:
            if words:
                hashes.append(digest(b" ".join(words), SEED))
        else:
            line = b" ".join(words)
            after = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(1, len(words) + 1)
            first = [0, *after[:-width].tolist()]
            hashes += [digest(line[i : j - 1], SEED) for i, j in zip(first, after[width - 1 :].tolist())]
        ends.append(len(hashes))
    end = np.array(ends, dtype=np.int64)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(end > start)
    if len(full):
        # Counters of a byte each hold 255 hashes at most, so every document is summed in runs of that length.
        runs = [np.arange(s, e, 255) for s, e in zip(start[full], end[full])]
        of_run = np.concatenate(([0], np.cumsum([len(r) for r in runs])[:-1]))
        cuts = np.concatenate(runs)
        values = np.array(hashes, dtype=np.uint64)
        half = (end - start)[full]
        bits = np.zeros(len(full), np.uint64)
        for j in range(8):
            sums = np.add.reduceat((values >> np.uint64(j)) & _LANES, cuts)
            counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), of_run, axis=0)
            for byte in range(8):
                bits |= (2 * counts[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + j)
        out[full] = bits
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", name: str = "fp") -> DataFrame:
    """``id, fp`` of every row: A-Z lower-cased, words cut at ASCII white space, 4-word shingles with repeats.

    Fewer words than a shingle has: the whole sequence is one; null texts and texts without words: 0.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("t"))
    kind = docs.schema[id].dataType.simpleString()
    found = arrow_step(rows, "t", f"id {kind}, fp bigint", lambda batch, t: [batch.column("id"), fingerprints_of(t)])
    return found.select(F.col("id").alias(id), F.col("fp").alias(name))


def _byte(fp: Column, p: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))


def _pairs(postings: DataFrame, key: list[str], max_bits: int, once: bool) -> DataFrame:
    """Pairs below one posting that share enough bytes and differ in few enough bits.

    All tests stand in the join's condition: only linked pairs leave the join.
    """
    a, b = postings.alias("a"), postings.alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    equal = sum((F.when(_byte(apart, p) == 0, 1 << p).otherwise(0) for p in range(1, 8)), F.when(_byte(apart, 0) == 0, 1).otherwise(0))
    same = F.col(f"a.{key[0]}") == F.col(f"b.{key[0]}")
    for k in key[1:]:
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    cond = same & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(apart) <= max_bits) & (F.bit_count(equal) >= 8 - max_bits)
    if once:
        cond &= F.element_at(F.lit(_FIRST), (equal + 1).cast("int")) == F.shiftrightunsigned(F.col("a.key"), 24)
    return a.join(b, cond).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def linked_pairs(prints: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints (``fp``) that differ in at most ``max_bits`` (0 to 4) bits.

    Differing bits touch at most as many bytes, so linked fingerprints share at least four of the eight positional
    bytes. A list per single byte would hold 1/256 of all fingerprints and pairs would grow with their square; the
    index is kept on three positional bytes instead, in the 20 combinations that every four bytes contain one of.
    Within a posting the shared positional bytes of a pair are tallied, pairs under the guaranteed count fall out, and
    the bits are compared. A pair is taken from its first common posting only. Posting lists over ``long_list`` are
    read through a fourth byte, as any linked pair shares one.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be between 0 and 4")
    fp = F.col("fp")
    keys = [
        _byte(fp, i) + F.shiftleft(_byte(fp, j), 8) + F.shiftleft(_byte(fp, k), 16) + F.lit(n << 24)
        for n, (i, j, k) in enumerate(POSTINGS)
    ]
    postings = prints.select("fp", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))
    long = postings.groupBy("key").count().where(F.col("count") > long_list).select("key")
    long = stored(long, "long-lists")
    if long.isEmpty():
        return _pairs(postings, ["key"], max_bits, True)
    short = _pairs(postings.join(long, "key", "left_anti"), ["key"], max_bits, True)
    fourth = F.array(*[F.struct(F.lit(p).alias("p"), _byte(fp, p).alias("v")) for p in range(8)])
    deep = postings.join(long, "key").select("fp", "key", F.explode(fourth).alias("x")).select("fp", "key", "x.p", "x.v")
    inside = [t for t in POSTINGS]
    outside = F.lit(False)
    for n, t in enumerate(inside):
        outside |= (F.shiftrightunsigned("key", 24) == n) & ~F.col("p").isin(*t)
    return short.union(_pairs(deep.where(outside), ["key", "p", "v"], max_bits, True)).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``id, fingerprint, component_id`` of every row of ``docs``.

    Rows with equal fingerprints form a class, classes are linked by :func:`linked_pairs`, and the component is the
    smallest id reachable. Null ids take part but never name a component; a repeated row is a member like any other;
    an empty table gives an empty result. Columns other than the two named are not read.
    """
    rows = stored(fingerprints(docs, id, text), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min(id).alias("first"))
    near = components(linked_pairs(classes.select("fp"), max_bits))
    group = F.coalesce("component", "fp").alias("group")
    classes = stored(classes.join(near, F.col("fp") == F.col("node"), "left").select("fp", "first", group), "classes")
    merged = classes.join(near.select(F.col("component").alias("group")).distinct(), "group", "left_semi")
    merged = merged.groupBy("group").agg(F.min("first").alias("low"))
    label = classes.join(merged, "group", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(label, "fp", "left").select(id, hexed, "component_id")


def first_of_each_group(docs: DataFrame, max_bits: int = MAX_BITS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id, a row without an id last.

    Rows are near copies if their fingerprints differ in at most ``max_bits`` bits, or are connected by such rows. The
    decision falls on rows: ids may repeat or be missing, and of repeated rows (equal id and text) one stays. Columns
    may have any name. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    table, own_id, own_text = keyed(docs, id, text)
    kind = docs.schema[id].dataType.simpleString()
    rows = table.select(F.col(own_id).alias("id"), "k", "l", F.col(own_text).cast("binary").alias("t"))

    def step(batch, texts: list) -> list:
        return [*(batch.column(c) for c in ("id", "k", "l")), fingerprints_of(texts)]

    try:
        prints = scratch.stored(arrow_step(rows, "t", f"id {kind}, k long, l long, fp bigint", step), "fingerprints")
        place = F.struct(F.col("id").isNull().alias("none"), "id", "k", "l")
        classes = scratch.stored(prints.groupBy("fp").agg(F.min(place).alias("first")), "classes")
        near = components(linked_pairs(classes.select("fp"), max_bits), scratch=scratch)
        label = classes.join(near, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
        label = scratch.stored(label, "labels")
        keep = label.groupBy("part").agg(F.min("first").alias("keep"))
        keep = label.select("fp", "part").join(keep, "part").select("fp", F.col("keep.k").alias("k2"), F.col("keep.l").alias("l2"))
        gone = prints.join(keep, "fp").where("k <> k2 or l <> l2").select("k", "l").distinct()
        gone = scratch.stored(gone, "gone", last=True)
    finally:
        scratch.sweep(True)
    order = F.xxhash64(*[F.col(f"c{i}") for i in range(len(docs.columns))])
    kept = table.join(gone, ["k", "l"], "left_anti").withColumn("again", F.row_number().over(Window.partitionBy("k", "l").orderBy(order)))
    return kept.where("again = 1").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_simhash_near_dedup(spark, root: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{root}/documents.parquet"))
