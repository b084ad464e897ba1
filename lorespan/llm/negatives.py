"""Hard negatives by exact integer scores; angles to reference directions tell which rows need scoring at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Reference directions, and rows of the sample that they are taken from.
DIRECTIONS, SAMPLE = 24, 1024
SEED = 12
#: Rows and anchors that meet in a task, and rows of a window within.
ROWS, ANCHORS, SPAN = 4096, 1024, 64
#: Scores from here on are not exact in double precision.
TOO_LARGE = float(1 << 53)
#: What angles may be off by, and scores, relatively and in all: bounds are widened by it.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9


def usable(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``id, label, vector`` of the rows that take part."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


def _whole(vectors: list, scale: int) -> np.ndarray:
    return np.floor(scale * np.array(vectors, dtype=np.float64))


def drawn_directions(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    """Random unit directions, for lengths of which the sample has no row."""
    found = np.random.default_rng([seed, dim]).standard_normal((n, max(dim, 1)))[:, :dim]
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def fitted_directions(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of the sample as unit directions, each as far as can be from those before it."""
    size = np.linalg.norm(sample, axis=1)
    units = sample[size > 0] / size[size > 0][:, None]
    if not len(units) or not units.shape[1]:
        return drawn_directions(sample.shape[1], n)
    taken, near = [0], units @ units[0]
    while len(taken) < min(n, len(units)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, units @ units[taken[-1]])
    return units[taken]


def angles_to(whole: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows and their angles to the directions; a zero row counts as standing at right angles to all."""
    norm = np.linalg.norm(whole, axis=1)
    return norm, np.arccos(np.clip(whole @ directions.T / np.where(norm > 0, norm, 1)[:, None], -1, 1))


def indexed(rows: DataFrame, scale: int = SCALE, directions: int = DIRECTIONS) -> DataFrame:
    """``row, id, label, dim, raw, norm, angles`` of every row: its integers as bytes, and the angles to the directions.

    The directions of each length come from the ``SAMPLE`` rows with the smallest hash of their id; every row is indexed.
    """
    sample = [r.vector for r in rows.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).select("vector").toLocalIterator()]
    known = {d: fitted_directions(_whole([v for v in sample if len(v) == d], scale), directions) for d in {len(v) for v in sample}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                values = part.column("vector").to_pylist()
                raw, norms, angles = [b""] * len(values), np.zeros(len(values)), [None] * len(values)
                for dim in {len(v) for v in values}:
                    own = [k for k, v in enumerate(values) if len(v) == dim]
                    whole = _whole([values[k] for k in own], scale)
                    norm, angle = angles_to(whole, known[dim] if dim in known else drawn_directions(dim, directions))
                    norms[own] = norm
                    for k, w, a in zip(own, whole, angle):
                        raw[k], angles[k] = w.astype("<f8").tobytes(), a
                columns = [part.column("id"), part.column("label"), pa.array([len(v) for v in values], pa.int32())]
                columns += [pa.array(raw, pa.binary()), pa.array(norms), pa.array(angles, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "dim", "raw", "norm", "angles"])

    kind = rows.schema["label"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id long, label {kind}, dim int, raw binary, norm double, angles array<double>")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "angles")


class _Side:
    """The rows of one length in a block, as arrays."""

    def __init__(self, rows: pa.Table, dim: int):
        self.rows = rows
        self.row, self.id, self.norm = (rows[c].to_numpy() for c in ("row", "id", "norm"))
        self.whole = np.frombuffer(b"".join(rows["raw"].to_pylist()), "<f8").reshape(len(rows), dim)
        self.angles = np.array(rows["angles"].to_pylist(), np.float64).reshape(len(rows), -1)


def score_bounds(norm: np.ndarray, angles: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Bounds of the scores of each anchor with the rows of each window, wide enough for any rounding.

    ``low, high`` are the smallest and largest angles of each window to every direction, ``least, most`` its norms. Two
    vectors are apart by the difference of their angles to a direction at least, by the sum at most, and by the sum
    of what both lack to the opposite direction.
    """
    apart = np.zeros((len(norm), len(low)))
    within = np.full((len(norm), len(low)), np.pi)
    for k in range(angles.shape[1]):
        a = angles[:, k][:, None]
        apart = np.maximum(apart, np.maximum(a - high[:, k], low[:, k] - a))
        within = np.minimum(within, np.minimum(a + high[:, k], 2 * np.pi - a - low[:, k]))
    top, bottom = np.cos(np.maximum(apart - ANGLE_SLACK, 0)), np.cos(np.minimum(within + ANGLE_SLACK, np.pi))
    upper = norm[:, None] * np.where(top > 0, most, least) * top
    lower = norm[:, None] * np.where(bottom > 0, least, most) * bottom
    return np.floor(lower - SCORE_SLACK * np.abs(lower)) - 1, np.ceil(upper + SCORE_SLACK * np.abs(upper)) + 1


class _Best:
    """The best scores of each slot with their rows: higher scores first, ties by the smaller id."""

    def __init__(self, slots: int, size: int):
        self.score = np.full((slots, size), -np.inf)
        self.id = np.full((slots, size), np.iinfo(np.int64).max)
        self.row = np.zeros((slots, size), np.int64)

    def take(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offer ``scores`` (slots by rows, minus infinity for none)."""
        some = (scores >= self.score[slots, -1][:, None]) & (scores > -np.inf)
        live = some.any(axis=1)
        slots, scores = slots[live], scores[live]
        if not len(slots):
            return
        shape = scores.shape
        score = np.concatenate([self.score[slots], scores], axis=1)
        id = np.concatenate([self.id[slots], np.broadcast_to(ids, shape)], axis=1)
        row = np.concatenate([self.row[slots], np.broadcast_to(rows, shape)], axis=1)
        order = np.lexsort((id, -score))[:, : self.score.shape[1]]
        for name, values in (("score", score), ("id", id), ("row", row)):
            getattr(self, name)[slots] = np.take_along_axis(values, order, axis=1)


def _windows(label: np.ndarray, angles: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the places where windows begin: rows of one label, near one direction, at like angles."""
    near = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(label), np.int64)
    angle = angles[np.arange(len(label)), near] if angles.shape[1] else np.zeros(len(label))
    order = np.lexsort((angle, near, label))
    change = np.ones(len(order), bool)
    change[1:] = (label[order][1:] != label[order][:-1]) | (near[order][1:] != near[order][:-1])
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(order)))
    cuts = -(-sizes // span)
    within = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    return order, np.repeat(starts, cuts) + span * within


def _meet(anchors: pa.Table, rows: pa.Table, size: int, span: int, same_label: bool, slots) -> Iterator[tuple]:
    """Score the rows of a block against its anchors, window by window, where the bounds leave a chance.

    ``slots(anchors)`` gives, for the anchors of one length, slot arrays ``(anchor, lowest, highest)``: scores a slot
    asks for. Yields the anchors, the slots, and their best rows.
    """
    labels = pa.chunked_array([*anchors["label"].chunks, *rows["label"].chunks]).combine_chunks().dictionary_encode()
    labels = (labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).indices.to_numpy(zero_copy_only=False)
    of_anchor, of_row = labels[: len(anchors)], labels[len(anchors) :]
    dims_a, dims_r = anchors["dim"].to_numpy(), rows["dim"].to_numpy()
    for dim in np.intersect1d(dims_a, dims_r).tolist():
        a, r = _Side(anchors.filter(pa.array(dims_a == dim)), dim), _Side(rows.filter(pa.array(dims_r == dim)), dim)
        label_a, label_r = of_anchor[dims_a == dim], of_row[dims_r == dim]
        order, starts = _windows(label_r, r.angles, span)
        ends = np.append(starts[1:], len(order))
        sorted_angles, sorted_norm = r.angles[order], r.norm[order]
        low, high = np.minimum.reduceat(sorted_angles, starts), np.maximum.reduceat(sorted_angles, starts)
        least, most = np.minimum.reduceat(sorted_norm, starts), np.maximum.reduceat(sorted_norm, starts)
        lower, upper = score_bounds(a.norm, a.angles, low, high, least, most)
        of, lowest, highest = slots(a.rows)
        best = _Best(len(of), size)
        label_w = label_r[order[starts]]
        for w in np.argsort(-upper.max(axis=0, initial=-np.inf)).tolist():
            fits = (label_a[of] == label_w[w]) == same_label
            fits &= (upper[of, w] >= np.maximum(lowest, best.score[:, -1])) & (lower[of, w] <= highest)
            open_ = np.flatnonzero(fits)
            if not len(open_):
                continue
            own = order[starts[w] : ends[w]]
            asked, place = np.unique(of[open_], return_inverse=True)
            scores = (a.whole[asked] @ r.whole[own].T)[place]
            apart = a.row[of[open_]][:, None] != r.row[own]
            inside = (scores >= lowest[open_][:, None]) & (scores <= highest[open_][:, None]) & apart
            best.take(open_, np.where(inside, scores, -np.inf), r.id[own], r.row[own])
        yield a, of, best


def _paired(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, step, schema: str) -> DataFrame:
    """Let every block of anchors meet every block of rows in a task of its own; blocks are hashes of the row."""
    a_blocks, r_blocks = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    dealt_a = anchors.withColumn("ab", F.pmod(F.xxhash64("row"), F.lit(a_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))))
    dealt_r = rows.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(r_blocks)).cast("int")).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))))
    # Anchors are rows of the same table: their columns need names of their own to be told apart.
    dealt_a = dealt_a.withColumn("ab", F.col("ab").cast("int"))
    dealt_a = dealt_a.select(*[F.col(c).alias(c) for c in dealt_a.columns])
    return dealt_a.groupBy("ab", "rb").cogroup(dealt_r.groupBy("ab", "rb")).applyInArrow(step, schema)


def _first(df: DataFrame, by: list[str], n: int, score: str, id: str) -> DataFrame:
    """The first ``n`` rows of each group with their rank; Spark cuts groups before it shuffles them."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), id)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor and positive.

    Components become ``floor(scale * x)``, a score is the inner product of such integers. The positives of an anchor (a
    row where ``is_anchor``, over a column ``id``) are its first ``positives`` other rows of the same label, by higher
    score, then smaller id; their negatives the first ``negatives`` rows of another label with
    ``low * positive <= 100 * negative <= high * positive``. Fewer are returned where there are fewer.

    Every row is stored once with its norm and its angles to reference directions. In a task a block of anchors meets a
    block of rows, sorted into windows; angles and norms bound the scores of a window, and only windows whose bounds
    overlap what an anchor asks for are scored, exactly. A block sends its best rows alone.

    Rows with a null id, label or vector, or with null or non-finite components take no part; vectors of different
    length are not compared; repeated rows and rows of equal id are rows like any other, and an anchor is only not its
    own positive. Other columns are not read. An empty table gives an empty result. A table in which a score could
    exceed 2^53 is refused with a ``ValueError``.
    """
    rows = indexed(usable(vectors, id, vector, label), scale)
    n_rows, largest = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    if (largest or 0) ** 2 >= TOO_LARGE:
        raise ValueError("scores of these vectors are not exact in double precision")
    anchors = rows.where(is_anchor)
    n_anchors = anchors.count()

    def of_positives(found: pa.Table) -> tuple:
        n = len(found)
        return np.arange(n), np.full(n, -np.inf), np.full(n, np.inf)

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "anchor_id", "positive", "positive_id", "positive_score"]
        out = [np.zeros(0, np.int64)] * 5
        for a, of, best in _meet(left, right, positives, SPAN, True, of_positives) if len(left) and len(right) else ():
            slot, place = np.nonzero(best.score > -np.inf)
            hit = best.row[slot, place], best.id[slot, place], best.score[slot, place].astype(np.int64)
            out = [np.concatenate(c) for c in zip(out, (a.row[of[slot]], a.id[of[slot]], *hit))]
        return pa.table([pa.array(c, pa.int64()) for c in out], names)

    shape = "anchor long, anchor_id long, positive long, positive_id long, positive_score long"
    some = _paired(anchors, rows, n_anchors, n_rows, near, shape)
    first = stored(_first(some, ["anchor"], positives, "positive_score", "positive_id").drop("rank"), "positives")
    asked = first.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("asked"))
    asking = anchors.join(asked, F.col("row") == F.col("anchor")).drop("anchor")

    def of_negatives(found: pa.Table) -> tuple:
        lists = found["asked"].to_pylist()
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        score = np.array([p["positive_score"] for x in lists for p in x], np.int64)
        return of, -((-low * score) // 100).astype(np.float64), ((high * score) // 100).astype(np.float64)

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative_score"]
        out = [np.zeros(0, np.int64)] * 7
        for a, of, best in _meet(left, right, negatives, SPAN, False, of_negatives) if len(left) and len(right) else ():
            slot, place = np.nonzero(best.score > -np.inf)
            asked_ = [p for x in a.rows["asked"].to_pylist() for p in x]
            of_slot = [np.array([p[c] for p in asked_], np.int64)[slot] for c in ("positive", "positive_id", "positive_score")]
            hit = best.id[slot, place], best.score[slot, place].astype(np.int64)
            out = [np.concatenate(c) for c in zip(out, (a.row[of[slot]], a.id[of[slot]], *of_slot, *hit))]
        return pa.table([pa.array(c, pa.int64()) for c in out], names)

    found = _paired(asking, rows, n_anchors, n_rows, hard, shape + ", negative_id long, negative_score long")
    found = _first(found, ["anchor", "positive"], negatives, "negative_score", "negative_id")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, root: str) -> DataFrame:
    """Hard negatives of every hundredth vector, among all; every seventh label is made wrong."""
    vectors = spark.read.parquet(f"{root}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", label), F.col("id") % 100 == 0)


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank,
       id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
