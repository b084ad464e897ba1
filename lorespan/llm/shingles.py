"""Near copies of documents by Jaccard similarity of their word shingles, complete at the given similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import Scratch, arrow_step, components, keyed

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: Documents of which the frequent shingles are learned, the share of them that makes one frequent, and their largest number.
#: They order the shingles alone: whatever they are, no pair is missed.
SAMPLE_DOCS, FREQUENT_SHARE, FREQUENT = 20_000, 0.001, 100_000


def shingles_of(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``width`` are one, no words an empty one."""
    words = text.lower().split() if text else []
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(g) for g in grams], dtype=np.uint64))


def rarest_first(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes as longs in an order with the frequent ones last, by rank; ``frequent`` is sorted."""
    codes = (hashes >> np.uint64(2)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hit = frequent[at] == hashes
        codes[hit] = (1 << 62) + rank[at[hit]]
    return np.unique(codes)


def frequent_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many of a bounded sample of ``rows`` (``k, t``) hold, sorted, with their rank by frequency."""
    every = max(1, rows.count() // SAMPLE_DOCS)
    some = rows.where(F.pmod("k", F.lit(every)) == 0)

    def step(batch: pa.RecordBatch, texts: list) -> list:
        found = [shingles_of(t, width).view(np.int64) for t in texts]
        return [pa.array(np.concatenate(found))]

    counts = arrow_step(some, "t", "shingle long", step).groupBy("shingle").count()
    least = max(3, int(FREQUENT_SHARE * SAMPLE_DOCS))
    top = counts.where(F.col("count") >= least).orderBy(F.desc("count"), "shingle").limit(FREQUENT)
    found = np.array([r.shingle for r in top.toLocalIterator()], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - 1 - order).astype(np.int64)


def _possible(x: str, y: str, least: float) -> Column:
    """Whether two sets of which the entries at ``pos`` are the first in common can reach the similarity."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    common = 1 + F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return common * (1 + F.lit(least)) >= F.lit(least) * (n + m) - 1e-9


def _alike(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """The pairs of classes (``a, b``) whose sets reach the similarity; sets are formed anew from the texts of pairs."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if known[0] != a:
                    known = a, shingles_of(one.as_py(), width)
                y = shingles_of(two.as_py(), width)
                common = len(np.intersect1d(known[1], y, assume_unique=True))
                keep.append(common >= least * (len(known[1]) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def linked_classes(reps: DataFrame, rows: DataFrame, least: float, width: int, scratch: Scratch) -> DataFrame:
    """``node, component`` of classes of equal sets that are connected by a Jaccard similarity of ``least``.

    ``reps`` have ``node, first, n`` and ``prefix``, the first entries of the set. Similar sets share at least ``least``
    of either, so in any common order their first common entry is among the first ``(1 - least) n + 1`` of both: only
    these are posted, and no pair is missed. Rare shingles come first, so a passage that many documents share is posted
    by documents of little else alone. Members of a posting list are held against the first and the one before; lists
    that then still hold different components are compared further, between components alone.
    """
    posted = reps.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    posted = posted.select("key", F.struct("node", "n", (F.col("at") + 1).alias("pos")).alias("x"))
    below = Window.partitionBy("key").orderBy("x.node")
    ranked = posted.select("key", "x", F.first("x").over(below).alias("head"), F.lag("x").over(below).alias("last"), F.lead("x.node").over(below).alias("next"))
    lists = scratch.stored(ranked.where("last is not null or next is not null").select("key", "x", "head", "last"), "shingle-lists")
    pair = lambda a: lists.where(F.col("last").isNotNull() & _possible(a, "x", least)).select(F.col(f"{a}.node").alias("a"), F.col("x.node").alias("b"))
    near = scratch.stored(pair("head").union(pair("last")).distinct(), "near-documents")
    # The texts of classes in any list: all documents are shuffled for them once, later only these.
    listed = lists.select("x.node").distinct().join(reps.select("node", "first.k", "first.l"), "node")
    texts = scratch.stored(rows.select("k", "l", "t").join(listed, ["k", "l"]).select("node", "t"), "texts")
    scratch.sweep()
    links = scratch.stored(_alike(near, texts, least, width), "document-links")
    scratch.sweep()
    parts = scratch.stored(components(links, scratch=scratch), "parts")
    member = lists.select("key", "x", F.col("last.node").alias("before"), F.col("head.node").alias("head")).join(parts, F.col("x.node") == F.col("node"), "left")
    member = member.select("key", "x", "before", "head", F.coalesce("component", "x.node").alias("part"))
    mixed = member.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    member = scratch.stored(member.join(mixed, "key", "left_semi"), "members")
    a = member.select("key", "x", "part", "head")
    b = member.select(F.col("key").alias("key2"), F.col("x").alias("y"), F.col("part").alias("part2"), F.col("before").alias("before2"))
    apart = (F.col("key") == F.col("key2")) & (F.col("part") != F.col("part2")) & (F.col("x.node") < F.col("y.node"))
    apart &= (F.col("x.node") != F.col("before2")) & (F.col("x.node") != F.col("head")) & _possible("x", "y", least)
    more = a.join(b, apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    more = scratch.stored(more, "near-documents")
    scratch.sweep()
    if more.isEmpty():
        return parts
    return scratch.stored(components(links.union(_alike(more, texts, least, width)), scratch=scratch), "parts")


def first_of_each_group(
    docs: DataFrame, least: float = MIN_SIMILARITY, width: int = SHINGLE, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id, a row without an id last.

    Rows are near copies if the sets of their shingles (words between ASCII white space, A-Z lower-cased) have a Jaccard
    similarity of at least ``least``, or are connected by such rows. A null, an empty text and a text without words have
    the same set; a text of fewer than ``width`` words is one shingle; texts of any length are read whole. The decision
    falls on rows: ids may repeat or be missing, and of repeated rows (equal id and text) one stays. Columns may have any
    name. Different sets whose hashes collide stay. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    table, own_id, own_text = keyed(docs, id, text)
    kind = docs.schema[id].dataType.simpleString()
    rows = table.select(F.col(own_id).alias("id"), "k", "l", F.col(own_text).cast("binary").alias("t"))
    frequent, rank = frequent_shingles(rows.select("k", "t"), width)

    def step(batch: pa.RecordBatch, texts: list) -> list:
        sets = [rarest_first(shingles_of(t, width), frequent, rank) for t in texts]
        heads = [s[: int((1 - least) * len(s) + 1e-9) + 1] for s in sets]
        hashes = [np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64) for seed in (1, 2)]
        ends = pa.array(np.cumsum([0, *map(len, heads)]), pa.int32())
        prefix = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(heads), pa.int64()))
        n = pa.array([len(s) for s in sets], pa.int32())
        return [*(batch.column(c) for c in ("id", "k", "l")), *map(pa.array, hashes), n, prefix]

    try:
        prints = arrow_step(rows, "t", f"id {kind}, k long, l long, h long, check long, n int, prefix array<bigint>", step)
        prints = scratch.stored(prints, "shingles")
        place = [F.col("id").isNull().alias("none"), "id", "k", "l"]
        met = prints.groupBy("h").agg(F.min(F.struct(*place, "n", "prefix")).alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
        met = met.where("low = high").select(F.col("h").alias("node"), F.struct(*(f"first.{c}" for c in ("none", "id", "k", "l"))).alias("first"), "first.n", "first.prefix")
        reps = scratch.stored(met, "classes")
        near = linked_classes(reps, rows, least, width, scratch)
        label = reps.select("node", "first").join(near.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        label = scratch.stored(label.select("node", "first", F.coalesce("component", "node").alias("part")), "labels")
        keep = label.groupBy("part").agg(F.min("first").alias("keep"))
        keep = label.select("node", "part").join(keep, "part").select(F.col("node").alias("h"), "keep.k", "keep.l")
        gone = prints.select("h", F.col("k").alias("k2"), F.col("l").alias("l2")).join(keep, "h").where("k <> k2 or l <> l2")
        gone = scratch.stored(gone.select(F.col("k2").alias("k"), F.col("l2").alias("l")).distinct(), "gone", last=True)
    finally:
        scratch.sweep(True)
    order = F.xxhash64(*[F.col(f"c{i}") for i in range(len(docs.columns))])
    kept = table.join(gone, ["k", "l"], "left_anti").withColumn("again", F.row_number().over(Window.partitionBy("k", "l").orderBy(order)))
    return kept.where("again = 1").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
