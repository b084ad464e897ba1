"""Near-duplicate embeddings: spherical-cap filters of random product codes, joined per filter and verified."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import components, stored

MIN_COSINE = 0.93
#: Words of each half of the product code; every pair of words is a filter direction.
WORDS = 1024
#: Standard deviations that a vector must reach along a filter direction. A vector exceeds some 53 of the 1,048,576 directions.
REACH = 3.7
SEED = 11
#: Vectors of fewer components have no filters worth the name: they share one, and are compared part by part.
LEAST_DIMENSIONS = 16
#: Members of a filter that are compared with one another in a task; larger filters are cut into parts of this size.
PART = 512


@functools.cache
def _code(dimensions: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation, and the words of both halves, each of length sqrt(1/2): a pair of them has length one."""
    rng = np.random.default_rng([seed, dimensions])
    rotation, _ = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
    halves = []
    for size in (dimensions // 2, dimensions - dimensions // 2):
        half = rng.standard_normal((words, size))
        halves.append(half / np.linalg.norm(half, axis=1, keepdims=True) * np.sqrt(0.5))
    return rotation, halves[0], halves[1]


def decode(unit: np.ndarray, words: int = WORDS, reach: float = REACH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """All filters that each row exceeds, as row and filter number, sorted by both.

    The list is found half by half: a word of the first half stays in play only if the best word of the second half
    could still lift the pair over the threshold. A row that exceeds none takes its best filter.
    """
    if unit.shape[1] < LEAST_DIMENSIONS:
        return np.arange(len(unit)), np.zeros(len(unit), np.int64)
    rotation, first, second = _code(unit.shape[1], words, seed)
    turned = unit @ rotation
    cut = unit.shape[1] // 2
    a = turned[:, :cut] @ first.T
    b = turned[:, cut:] @ second.T
    need = np.minimum(reach / np.sqrt(unit.shape[1]), a.max(axis=1) + b.max(axis=1) - 1e-12)
    row, word = np.nonzero(a >= (need - b.max(axis=1))[:, None])
    rows, filters = [], []
    for i in range(0, len(row), 4096):
        r, w = row[i : i + 4096], word[i : i + 4096]
        hit, other = np.nonzero(b[r] >= (need[r] - a[r, w])[:, None])
        rows.append(r[hit])
        filters.append(w[hit] * words + other)
    row, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, filters))
    order = np.lexsort((found, row))
    return row[order], found[order]


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square over- or underflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the vectors that can link at all."""
    keep = []
    for i, v in enumerate(vectors):
        if v is not None and len(v) and None not in v:
            x = np.array(v, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                keep.append((i, x))
    return np.array([i for i, _ in keep], np.int64), [x for _, x in keep]


def _cell(vectors: DataFrame) -> str:
    """What a component takes: four bytes if the table holds single precision, else eight."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def filters_of(vectors: DataFrame) -> DataFrame:
    """``label, embedding, rep, n, dim, filters, raw`` of every distinct vector that can link; ``raw`` are its values' bytes."""
    cell = _cell(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                keep, values = _valid(part.column("embedding").to_pylist())
                lists: list = [None] * len(keep)
                for size in {len(v) for v in values}:
                    own = [k for k, v in enumerate(values) if len(v) == size]
                    row, found = decode(_units(np.array([values[k] for k in own])))
                    cut = np.searchsorted(row, np.arange(len(own) + 1))
                    for k, x, y in zip(own, cut, cut[1:]):
                        lists[k] = found[x:y].astype(np.int32)
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(at) for c in ("label", "embedding", "rep", "n")),
                        pa.array([len(v) for v in values], pa.int32()),
                        pa.array(lists, pa.list_(pa.int32())),
                        pa.array([v.astype(cell).tobytes() for v in values], pa.binary()),
                    ],
                    ["label", "embedding", "rep", "n", "dim", "filters", "raw"],
                )

    kind = vectors.schema["label"].dataType.simpleString()
    values = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(
        run, f"label {kind}, embedding {values}, rep long, n long, dim int, filters array<int>, raw binary"
    )


def _links(here: int, crossed: np.ndarray | None, unit: np.ndarray, rep: np.ndarray, n: np.ndarray, filters: list, least: float):
    """Links within one filter that no smaller common filter has: per vector their number, and a forest of them.

    ``crossed`` are the parts of the rows where two parts meet, else None.
    """
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    if crossed is not None:
        near &= crossed[:, None] != crossed[None, :]
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return None
    some = some[np.argsort(rep[some])]
    near, rep, n = near[np.ix_(some, some)], rep[some], n[some]
    smaller = [np.array(filters[k], dtype=np.int64) for k in some]
    smaller = [f[f < here] for f in smaller]
    names, place = np.unique(np.concatenate(smaller), return_inverse=True)
    if len(names):
        holds = np.zeros((len(some), len(names)), np.float32)
        holds[np.repeat(np.arange(len(some)), [len(f) for f in smaller]), place] = 1
        near &= holds @ holds.T == 0
    root = np.arange(len(rep))
    while True:  # smallest root among the neighbours, until nothing changes
        low = np.minimum(root, np.where(near, root[None, :], len(root)).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    keep = near.any(axis=1)
    return rep[keep], (near @ n)[keep], rep[root][keep]


def _verify(min_cosine: float, cell: str):
    """Compare the rows of each filter and pair of parts. Rows come sorted by these; a group that a batch cuts waits."""

    def links_of(rows: pa.Table, starts: np.ndarray) -> list[tuple]:
        dims, here, lo, hi, part, node, n = (rows[c].to_numpy() for c in ("dim", "filter", "lo", "hi", "part", "node", "n"))
        flat, at = np.frombuffer(b"".join(rows["raw"].to_pylist()), cell), np.append(0, np.cumsum(dims))
        ends = np.append(starts[1:], len(rows))
        sizes = ends - starts
        large = sizes > 2
        pairs = starts[sizes == 2]
        for dim in np.unique(dims[pairs]):
            # Most filters have two members: their cosines are one product.
            own = pairs[dims[pairs] == dim]
            one, two = (_units(flat[at[own + k][:, None] + np.arange(dim)]) for k in (0, 1))
            large |= np.isin(starts, own[(one * two).sum(axis=1) >= min_cosine - 1e-9])
        found = []
        for i, j in zip(starts[large].tolist(), ends[large].tolist()):
            unit = _units(flat[at[i] : at[j]].reshape(j - i, -1))
            near = unit @ unit.T
            if np.count_nonzero(near >= min_cosine) <= j - i and (near.diagonal() >= min_cosine).all():
                continue
            crossed = part[i:j] if lo[i] != hi[i] else None
            filters = rows["filters"].slice(i, j - i).to_pylist()
            links = _links(int(here[i]), crossed, unit, node[i:j], n[i:j], filters, min_cosine)
            if links is not None:
                found.append(links)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if wait is None else pa.concat_tables([wait, rows])
            label = rows["label"].combine_chunks().dictionary_encode()
            label = label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label
            keys = [label.indices.to_numpy(zero_copy_only=False), *(rows[c].to_numpy() for c in ("dim", "filter", "lo", "hi"))]
            change = np.zeros(len(rows), bool)
            change[:1] = True
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(change)
            if len(starts) > 1:
                yield _found(links_of(rows.slice(0, int(starts[-1])), starts[:-1]))
            wait = rows.slice(int(starts[-1])) if len(starts) else wait
        if wait is not None and len(wait):
            yield _found(links_of(wait, np.zeros(1, np.int64)))

    return run


def _found(links: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*links)] or [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])


def near_vectors(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    part: int = PART,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row of ``vectors``.

    Equal vectors of a label form a class, so copies are compared once. A class goes to all filters that it exceeds;
    members of a filter are compared in parts of ``part`` rows, every part with every other, so a large filter is more
    tasks and not a larger one. A link counts in the smallest filter that both ends have. Links leave a task as sums
    per vector and as a forest, never as pairs. Vectors of different length never link.

    ``n_links`` counts the other rows linked; the component is the smallest id reachable. Rows whose vector or label is
    null, or whose vector is zero, empty or holds null or non-finite values, link with nothing; so do rows without an
    id, whose component stays null. Repeated rows are linked copies.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    able = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    classes = rows.where(able).groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # Numbered once they are stored: an id may stand in several classes.
    known = stored(filters_of(classes).withColumn("node", F.monotonically_increasing_id()), "filters")
    keys = ["label", "dim", "filter"]
    members = known.select("label", "dim", "node", "n", "filters", F.explode("filters").alias("filter"))
    sizes = members.groupBy(*keys).count().where(F.col("count") > 1)
    parts = F.ceil(F.col("count") / part).cast("int").alias("parts")
    dealt = members.join(sizes.select(*keys, parts), keys)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pair = [F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")]
    dealt = dealt.select(*keys, "node", "n", "filters", "part", other).select(*keys, "node", "n", "filters", "part", *pair)
    dealt = dealt.join(known.select("node", "raw"), "node")
    by = [*keys, "lo", "hi"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by)
    found = stored(dealt.mapInArrow(_verify(min_cosine, _cell(rows)), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    near = components(found, "node", "root", "group").withColumnRenamed("node", "member")
    near = stored(near.join(known.select("node", "rep"), F.col("member") == F.col("node")).select("node", "group", "rep"), "near")
    names = near.groupBy("group").agg(F.min("rep").alias("component"))
    named = near.join(names, "group").select("node", "component")
    of_class = known.select("label", "embedding", "node", "n", "rep").join(links, "node", "left").join(named, "node", "left")
    all_links = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    of_class = of_class.select("label", "embedding", all_links, F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, ["label", "embedding"], "left")
    linked = F.col("id").isNotNull()
    component = F.when(linked, F.coalesce("component", "id"))
    out = out.select("id", F.when(linked, F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"), component.alias("component_id"))
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_embedding_near_dedup(spark, root: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(spark.read.parquet(f"{root}/embeddings.parquet"))
