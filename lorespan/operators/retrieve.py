"""Batch retrieval: many queries against a corpus of vectors, exact.

Scores are computed block by block as matrix products inside the tasks, and every block gives back only its best k
rows per query (or its hits above the radius), so all pairs are scored but never emitted or joined.

* ``plan="broadcast"`` (the default): the query matrix is broadcast and the corpus is scanned where it lies, without a
  shuffle. Each task keeps a running top k. The query side is measured before it is collected; more than
  ``BROADCAST_ROWS`` rows, ``BROADCAST_BYTES`` bytes or ``BROADCAST_HITS`` hits are an error, not a change of plan.
* ``plan="blocks"``: both sides are cut into blocks by a hash of their id. Every pair of blocks meets in one cogrouped
  task; a block has a bounded number of rows, whatever the data looks like.

Scores are rounded to nine places before ranking, so that ties do not depend on the order of summation; ties go to
the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StructField, StructType

from lorespan.functions import text as t
from lorespan.operators import dedup
from lorespan.operators.skew import first_rows

BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 << 20
BROADCAST_HITS = 1_000_000
BLOCK_BYTES = 32 << 20
METRICS = ("cosine", "ip", "l2", "l1")
_PLACES = 9
# Squared distances this small beside the squared lengths are taken from the differences, so many pairs at once.
_CANCELS = 1e-6
_PAIRS_AT_ONCE = 1 << 14
# Numbers of one slice of absolute differences.
_CACHED = 1 << 15
# Scores are taken of so many queries and rows of the corpus at once.
_QUERIES_AT_ONCE, _CORPUS_AT_ONCE = 256, 4096
# Scores closer than this may be equal once they are rounded.
_MARGIN = 10.0**-_PLACES


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs, not rounded; for ``cosine`` the vectors come as unit vectors."""
    if metric in ("cosine", "ip"):
        return q @ c.T
    return _l2(q, c) if metric == "l2" else _l1(q, c)


def _l2(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    qq, cc = (q * q).sum(1), (c * c).sum(1)
    d2 = q @ c.T
    d2 *= -2.0
    d2 += qq[:, None]
    d2 += cc
    # Nearly equal vectors cancel in the expansion: their distances are taken from the differences.
    r, j = np.nonzero(d2 <= _CANCELS * (qq[:, None] + cc.max(initial=0.0)))
    for at in range(0, len(r), _PAIRS_AT_ONCE):
        a, b = r[at : at + _PAIRS_AT_ONCE], j[at : at + _PAIRS_AT_ONCE]
        d2[a, b] = np.square(q[a] - c[b]).sum(1)
    np.sqrt(d2, out=d2)
    d2 += 1.0
    return np.divide(1.0, d2, out=d2)


def _l1(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Absolute differences by slices of the corpus that stay in the processor's cache."""
    s = np.empty((len(q), len(c)))
    rows = max(1, _CACHED // max(1, c.shape[1]))
    buffer = np.empty((rows, c.shape[1]))
    for at in range(0, len(c), rows):
        part = c[at : at + rows]
        diff = buffer[: len(part)]
        for i, row in enumerate(q):
            np.subtract(part, row, out=diff)
            np.abs(diff, out=diff)
            diff.sum(1, out=s[i, at : at + rows])
    s += 1.0
    return np.divide(1.0, s, out=s)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int | None):
    """Keep the k best (score down, id up) entries of every query row."""
    if k is None or not len(rows):
        return rows, ids, scores
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.r_[True, rows[1:] != rows[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    keep = np.arange(len(rows)) - start < k
    return rows[keep], ids[keep], scores[keep]


def _comparable(table: pa.Table | pa.RecordBatch, vector: str) -> pa.Table | pa.RecordBatch:
    """Rows without a full vector cannot be compared and are left out.

    This is done here and not by a filter, which the optimizer would push below an encoder and run that twice.
    """
    column = table.column(vector)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        table = table.filter(pa.compute.is_valid(column))
        return _comparable(table, vector)
    values = column.flatten() if len(column) else None
    if values is None or not values.null_count:
        return table
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(column)), lengths)
    whole = np.ones(len(column), bool)
    whole[owner[pa.compute.is_null(values).to_numpy(zero_copy_only=False)]] = False
    return table.filter(pa.array(whole))


class _Side:
    """Ids, vectors and (for hybrid scores) word hashes of one block."""

    def __init__(self, table: pa.Table | pa.RecordBatch, id_col: str, vector: str):
        table = _comparable(table, vector)
        self.ids = _ids(table.column(id_col))
        self.vectors = _matrix(table.column(vector))
        self.words = self.owner = None
        if "_words" in table.schema.names:
            column = table.column("_words")
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            self.words = column.flatten().to_numpy(zero_copy_only=False)
            self.owner = np.repeat(np.arange(len(lengths)), lengths)
            self.n_words = np.maximum(lengths, 1)

    def __len__(self) -> int:
        return len(self.ids)


def _overlap(q: _Side, lo: int, hi: int, c: _Side) -> np.ndarray:
    """Shared distinct words of queries ``lo..hi`` and all documents, over the number of query words."""
    mine = (q.owner >= lo) & (q.owner < hi)
    order = np.argsort(q.words[mine], kind="stable")
    vocabulary, owners = q.words[mine][order], q.owner[mine][order] - lo
    left = np.searchsorted(vocabulary, c.words, "left")
    count = np.searchsorted(vocabulary, c.words, "right") - left
    # Every document word meets the query words equal to it.
    at = np.repeat(left - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    cells = owners[at] * len(c) + np.repeat(c.owner, count)
    shared = np.bincount(cells, minlength=(hi - lo) * len(c)).reshape(hi - lo, len(c))
    return shared / q.n_words[lo:hi, None]


def _own(ids: np.ndarray, sorted_ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query row, corpus row) of equal ids, which are looked up, not compared pair by pair."""
    first = np.searchsorted(sorted_ids, ids, "left")
    count = np.searchsorted(sorted_ids, ids, "right") - first
    at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    return np.repeat(np.arange(len(ids)), count), order[at]


def _hits(q: _Side, c: _Side, args: dict):
    """Candidates (query row, corpus id, score) of one block pair: the k best per query, or all above the score."""
    k, min_score, alpha = args["k"], args["min_score"], args["alpha"]
    # The overlap of words is counted over a whole block of documents, scores of vectors by slices that stay in the cache.
    step = max(1, (4 << 20) // max(1, len(c))) if alpha is not None else _QUERIES_AT_ONCE
    width = len(c) if alpha is not None else _CORPUS_AT_ONCE
    parts = []
    if not len(c):
        return np.array([], int), c.ids, np.array([], float)
    order = np.argsort(c.ids, kind="stable") if args["exclude_self"] else None
    sorted_ids = c.ids[order] if args["exclude_self"] else None
    qv, cv = (_unit(q.vectors), _unit(c.vectors)) if args["metric"] == "cosine" else (q.vectors, c.vectors)
    for lo in range(0, len(q), step):
        hi = min(lo + step, len(q))
        own_q, own_c = _own(q.ids[lo:hi], sorted_ids, order) if args["exclude_self"] else (None, None)
        rows, ids, scores = np.array([], int), c.ids[:0], np.array([], float)
        # What a row must have to be among the k best of its query so far.
        edge = np.full(hi - lo, -np.inf if min_score is None else min_score)
        for at in range(0, len(c), width):
            s = _scores(qv[lo:hi], cv[at : at + width], args["metric"])
            if alpha is not None:
                s = np.round(alpha * np.round(s, _PLACES) + (1 - alpha) * _overlap(q, lo, hi, c), _PLACES)
            if args["exclude_self"]:
                here = (own_c >= at) & (own_c < at + width)
                s[own_q[here], own_c[here] - at] = -np.inf
            near = s > -np.inf
            if k is not None and s.shape[1] > k and at == 0:
                near &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - _MARGIN
            near &= s >= edge[:, None] - _MARGIN
            r, j = np.nonzero(near)
            found = np.round(s[r, j], _PLACES)
            if min_score is not None:
                r, j, found = (x[found >= min_score] for x in (r, j, found))
            if args.get("above_self"):
                r, j, found = (x[c.ids[at + j] > q.ids[lo + r]] for x in (r, j, found))
            rows, ids, scores = (np.concatenate(x) for x in ((rows, r), (ids, c.ids[at + j]), (scores, found)))
            if k is not None and len(r):
                rows, ids, scores = _best(rows, ids, scores, k)
                count = np.bincount(rows, minlength=hi - lo)
                full = count >= k
                edge[full] = scores[np.cumsum(count)[full] - 1]
        parts.append((rows + lo, ids, scores))
    if not parts:
        return np.array([], int), c.ids[:0], np.array([], float)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _side(df: DataFrame, id_col: str, vector: str, words: bool) -> DataFrame:
    """The columns that are scored."""
    cols = [F.col(id_col), F.col(vector).cast("array<double>").alias(vector)]
    if words:
        distinct = F.array_distinct(t.tokens(F.col("text")))
        cols.append(F.transform(distinct, lambda w: F.xxhash64(w)).alias("_words"))
    return df.select(*cols)


def _fits(queries: DataFrame, k: int | None, vector: str) -> None:
    """Raise if the scored columns of the queries, or the hits that they can have, are too large to broadcast."""
    size = F.coalesce(F.size(vector), F.lit(0)) * 8
    if "_words" in queries.columns:
        size += F.coalesce(F.size("_words"), F.lit(0)) * 8
    rows, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(size + 64), F.lit(0))).first()
    if rows > BROADCAST_ROWS or size > BROADCAST_BYTES or rows * (k or 0) > BROADCAST_HITS:
        raise ValueError(f"{rows} queries of {size} bytes are too many to broadcast: use plan='blocks'")


def _search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int | None,
    *,
    metric: str = "cosine",
    min_score: float | None = None,
    alpha: float | None = None,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    corpus_id: str = "vec_id",
    corpus_vector: str = "embedding",
    exclude_self: bool = False,
    above_self: bool = False,
    plan: str = "broadcast",
    block_rows: int | None = None,
) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if plan not in ("broadcast", "blocks"):
        raise ValueError(f"unknown plan: {plan}")
    if k is None and min_score is None:
        raise ValueError("give k or min_score")
    if k is not None and k <= 0:
        raise ValueError("k must be greater than zero")
    q = _side(queries, query_id, query_vector, alpha is not None)
    c = _side(corpus, corpus_id, corpus_vector, alpha is not None)
    args = dict(metric=metric, k=k, min_score=min_score, alpha=alpha, exclude_self=exclude_self, above_self=above_self)
    out = StructType(
        [
            StructField("_q", q.schema[query_id].dataType),
            StructField("_c", c.schema[corpus_id].dataType),
            StructField("score", DoubleType()),
        ]
    )
    if plan == "broadcast":
        _fits(q, k, query_vector)
        hits = _search_broadcast(_Side(q.toArrow(), query_id, query_vector), c, out, args, corpus_id, corpus_vector)
    else:
        # Copies sent are rows times blocks of the other side, so blocks are as large as a task can comfortably hold.
        width = q.agg(F.coalesce(F.max(F.size(query_vector)), F.lit(64))).first()[0]
        # Without a limit per query a pair of blocks gives back all its hits, so its blocks are smaller.
        most = BLOCK_BYTES if k is not None else BLOCK_BYTES // 8
        tasks = 1 if block_rows else 4 * queries.sparkSession.sparkContext.defaultParallelism
        block_rows = block_rows or max(1024, most // (8 * max(1, width)))
        hits = _search_blocks(q, c, out, args, query_id, query_vector, corpus_id, corpus_vector, block_rows, tasks)
    if k is not None:
        hits = first_rows(hits, ["_q"], [F.desc("score"), F.col("_c")], k, "rank")
    named = [F.col("_q").alias(query_id), F.col("_c").alias(corpus_id), "score"]
    return hits.select(*named, *([F.col("rank").cast("long").alias("rank")] if k is not None else []))


def search(queries: DataFrame, corpus: DataFrame, k: int | None = 5, **opts) -> DataFrame:
    """``(query id, corpus id, score, rank)``: exact nearest neighbours or, with ``k=None``, all hits ≥ ``min_score``.

    ``metric``: ``cosine``, ``ip`` (inner product), ``l2`` and ``l1`` (score ``1 / (1 + distance)``).
    Other options: ``min_score``, ``exclude_self`` (same id), ``above_self`` (greater ids alone), the column names ``query_id``, ``query_vector``,
    ``corpus_id``, ``corpus_vector``. Filters on metadata belong on ``corpus`` before the call, where they reach the
    scan.
    """
    return _search(queries, corpus, k, **opts)


def _table(rows, ids, scores, qids, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qids[rows], schema.field(0).type), pa.array(ids, schema.field(1).type), pa.array(scores)],
        schema=schema,
    )


def _arrow_schema(out: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(out)


def _ids(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy())


def _search_broadcast(q: _Side, c: DataFrame, out: StructType, args: dict, corpus_id: str, vector: str) -> DataFrame:
    shared = c.sparkSession.sparkContext.broadcast(q)
    schema = _arrow_schema(out)
    k = args["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        rows, ids, scores = np.array([], int), None, np.array([], float)
        for batch in batches:
            if not batch.num_rows or not len(mine):
                continue
            r, i, s = _hits(mine, _Side(batch, corpus_id, vector), args)
            if k is None:
                yield _table(r, i, s, mine.ids, schema)
                continue
            ids = i if ids is None else np.concatenate([ids, i])
            rows, ids, scores = _best(np.concatenate([rows, r]), ids, np.concatenate([scores, s]), k)
        if ids is not None and len(ids):
            yield _table(rows, ids, scores, mine.ids, schema)

    return c.mapInArrow(run, out)


def _search_blocks(q, c, out, args, query_id, query_vector, corpus_id, corpus_vector, block_rows, tasks) -> DataFrame:
    q_rows, c_rows = q.count(), c.count()
    q_blocks = max(1, math.ceil(q_rows / block_rows))
    # Few queries make for few pairs of blocks: the corpus is cut finer while the copies of the queries stay below it.
    finer = min(c_rows // max(1, q_rows), math.ceil(c_rows / 1024))
    c_blocks = max(1, math.ceil(c_rows / block_rows), finer)
    # Fewer pairs of blocks than ``tasks`` leave cores idle: both sides are cut finer, as long as blocks have 1,024 rows.
    more = math.sqrt(max(1.0, tasks / (q_blocks * c_blocks)))
    q_blocks = max(q_blocks, min(math.ceil(q_blocks * more), q_rows // 1024))
    c_blocks = max(c_blocks, min(math.ceil(c_blocks * more), c_rows // 1024))
    cut = lambda id_col, n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("_qb", cut(query_id, q_blocks)).withColumn("_cb", every(c_blocks))
    right = c.withColumn("_cb", cut(corpus_id, c_blocks)).withColumn("_qb", every(q_blocks))
    schema = _arrow_schema(out)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        mine = _Side(a, query_id, query_vector)
        r, i, s = _hits(mine, _Side(b, corpus_id, corpus_vector), args)
        return pa.Table.from_batches([_table(r, i, s, mine.ids, schema)])

    return left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInArrow(run, out)


def range_search(queries: DataFrame, corpus: DataFrame, radius: float, **opts) -> DataFrame:
    """All hits with a score of at least ``radius``."""
    return search(queries, corpus, None, min_score=radius, **opts)


def similarity_pairs(
    vectors: DataFrame, min_score: float, key: str = "vec_id", vector: str = "embedding", plan: str = "broadcast"
) -> DataFrame:
    """The similarity matrix as (left, right, score) with left < right and a score of at least ``min_score``."""
    pairs = search(
        vectors.select(F.col(key).alias("left"), F.col(vector)),
        vectors.select(F.col(key).alias("right"), F.col(vector)),
        None,
        min_score=min_score,
        query_id="left",
        corpus_id="right",
        above_self=True,
        plan=plan,
    )
    return pairs


def similarity_links(
    vectors: DataFrame, min_score: float, key: str = "vec_id", vector: str = "embedding", block_rows: int | None = None
) -> DataFrame:
    """``(key, class_id, n_links)``: the number of other vectors with a cosine of at least ``min_score``.

    Equal vectors form a class, named by its smallest key, and are compared once. Every unordered pair of blocks of
    classes meets in one task, which gives back one count per class: pairs are scored, but none is emitted.
    """
    classes = vectors.groupBy(vector).agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("_n"))
    width = classes.agg(F.coalesce(F.max(F.size(vector)), F.lit(64)), F.count(F.lit(1))).first()
    block_rows = block_rows or max(1024, BLOCK_BYTES // (8 * max(1, width[0])))
    n = max(1, math.ceil(width[1] / block_rows))
    rows = classes.where(F.col(vector).isNotNull()).select(
        "class_id", "_n", F.col(vector).cast("array<double>").alias(vector),
        F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int").alias("_b"),
    )
    # A block meets itself and, as the left one, every later block.
    left = rows.withColumn("_lo", F.col("_b")).withColumn("_hi", F.explode(F.sequence(F.col("_b"), F.lit(n - 1))))
    right = rows.withColumn("_hi", F.col("_b")).withColumn("_lo", F.explode(F.sequence(F.lit(0), F.col("_b"))))
    out = StructType([StructField("class_id", vectors.schema[key].dataType), StructField("_links", LongType())])
    schema = _arrow_schema(out)
    # The scores are those rounded to nine places.
    least = min_score - 0.5 * 10.0**-_PLACES

    def side(table: pa.Table):
        table = _comparable(table, vector)
        return _ids(table.column("class_id")), _ids(table.column("_n")).astype(np.float64), _unit(_matrix(table.column(vector)))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        within = a.column("_lo")[0].as_py() == a.column("_hi")[0].as_py()
        (ids, weights, unit), (others, other_weights, other_unit) = side(a), side(b)
        found, back = np.zeros(len(ids)), np.zeros(len(others))
        step = max(1, (2 << 20) // max(1, len(others)))
        for lo in range(0, len(ids) if len(others) else 0, step):
            near = (unit[lo : lo + step] @ other_unit.T >= least).astype(np.float64)
            found[lo : lo + step] = near @ other_weights
            if not within:
                back += weights[lo : lo + step] @ near
        if within:
            # A vector is no link of its own; its copies are.
            found -= (unit * unit).sum(1) >= least
            links = [(ids, found)]
        else:
            links = [(ids, found), (others, back)]
        named, counted = (np.concatenate(x) for x in zip(*links))
        return pa.Table.from_arrays([pa.array(named, schema.field(0).type), pa.array(counted.astype(np.int64))], schema=schema)

    pairs = left.groupBy("_lo", "_hi").cogroup(right.groupBy("_lo", "_hi")).applyInArrow(run, out)
    counts = pairs.groupBy("class_id").agg(F.sum("_links").alias("_links"))
    named = classes.join(counts, "class_id", "left").select(
        F.col(vector), "class_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links")
    )
    same = vectors.select(key, F.col(vector).alias("_v"))
    return same.join(named, F.col("_v").eqNullSafe(F.col(vector))).select(key, "class_id", "n_links")


def search_text(
    queries: DataFrame, corpus: DataFrame, encode: Callable[[DataFrame], DataFrame], k: int = 5, **opts
) -> DataFrame:
    """Embed the query texts with ``encode`` (adds ``embedding``), then search."""
    return search(encode(queries), corpus, k, **opts)


def filter_metadata(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Conjunction of equalities; a missing value equals only a missing value. Reaches the Parquet scan."""
    for name, value in filters.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df


def search_by_metadata(df: DataFrame, filters: dict[str, object], order: str, limit: int = 100) -> DataFrame:
    return filter_metadata(df, filters).orderBy(order).limit(limit)


def filter_results(hits: DataFrame, minimum_score: float = 0.3) -> DataFrame:
    return hits.where(F.col("score") >= minimum_score)


def format_results(distances: DataFrame) -> DataFrame:
    """Distances of a cosine store as scores."""
    return distances.withColumn("score", 1 - F.col("distance").cast("double"))


def keyword_overlap(query_text: Column, document_text: Column) -> Column:
    """Share of the distinct query words that occur in the document; 0 without query words."""
    return t.let(
        F.array_distinct(t.tokens(query_text)),
        lambda q: t.share(F.size(F.array_intersect(q, t.tokens(document_text))), F.size(q)),
    )


def _with_columns_of(hits: DataFrame, opts: dict, corpus: DataFrame, corpus_id: str) -> DataFrame:
    """Join the hits (ids, score and rank alone) back to the corpus.

    Under the broadcast plan their number has been checked, and the corpus is not shuffled for them.
    """
    return corpus.join(F.broadcast(hits) if opts.get("plan", "broadcast") == "broadcast" else hits, corpus_id)


def hybrid_search(queries: DataFrame, corpus: DataFrame, k: int = 5, alpha: float = 0.5, **opts) -> DataFrame:
    """``alpha`` · vector score + (1 − ``alpha``) · keyword overlap, over every pair, exact.

    Both tables carry ``text`` and the vector. Both parts are computed inside the blocks; ``alpha=1`` is plain search.
    """
    return search(queries, corpus, k, alpha=alpha, **opts)


def mmr_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    fetch_k: int = 20,
    lambda_mult: float = 0.5,
    *,
    query_id: str = "query_id",
    corpus_id: str = "vec_id",
    vector: str = "embedding",
    **opts,
) -> DataFrame:
    """Maximal marginal relevance: of the ``fetch_k`` best, pick ``k`` by λ·relevance − (1−λ)·similarity to the picked.

    One row per query holds its ``fetch_k`` candidates (a constant number), and the greedy picks are a fold over them.
    """
    from lorespan.operators.vectors import cosine_similarity

    hits = _search(queries, corpus, fetch_k, query_id=query_id, corpus_id=corpus_id, **opts)
    candidates = _with_columns_of(hits, opts, corpus.select(corpus_id, F.col(vector).alias("_v")), corpus_id)
    rows = candidates.groupBy(query_id).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col(corpus_id).alias("id"), "score", "_v"))).alias("cs")
    )
    kind = rows.schema["cs"].dataType.elementType
    id_type: DataType = kind["id"].dataType

    def pick(picked: Column, cs: Column) -> Column:
        def value(x: Column) -> Column:
            near = F.aggregate(
                picked,
                F.lit(None).cast("double"),
                lambda best, p: F.greatest(best, cosine_similarity(x["_v"], p["_v"])),
            )
            gain = lambda_mult * x["score"] - (1 - lambda_mult) * F.coalesce(near, F.lit(0.0))
            # Smaller is better: sort by gain down, then rank up.
            return F.struct((-F.round(gain, _PLACES)).alias("loss"), x["rank"].alias("rank"), x.alias("x"))

        free = F.filter(cs, lambda x: ~F.exists(picked, lambda p: p["id"] == x["id"]))
        best = F.array_min(F.transform(free, value))
        return F.when(F.size(picked) < F.size(cs), F.array_append(picked, best["x"])).otherwise(picked)

    empty = F.array().cast(ArrayType(kind))
    chosen = rows.withColumn(
        "picked",
        F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, lambda acc, _: pick(acc, F.col("cs"))),
    )
    out = chosen.select(query_id, F.posexplode("picked").alias("_p", "_x"))
    return out.select(
        query_id,
        (F.col("_p") + 1).cast("long").alias("rank"),
        F.col("_x")["id"].cast(id_type).alias(corpus_id),
        F.col("_x")["score"].alias("score"),
    )


def rerank(
    hits: DataFrame,
    k: int = 5,
    scorer: Callable[[list[str], list[str]], np.ndarray] | None = None,
    *,
    query_id: str = "query_id",
    corpus_id: str = "vec_id",
    query_text: str = "query_text",
    text: str = "text",
) -> DataFrame:
    """Score (query, text) pairs again and keep the k best per query.

    ``scorer`` is a batch function run over Arrow batches; the default is the keyword overlap.
    """
    if scorer is None:
        scored = hits.withColumn("rerank_score", F.round(keyword_overlap(F.col(query_text), F.col(text)), _PLACES))
    else:
        schema = StructType([*hits.schema.fields, StructField("rerank_score", DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = scorer(b.column(query_text).to_pylist(), b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(np.asarray(s, dtype=np.float64))], [*b.schema.names, "rerank_score"]
                )

        scored = hits.mapInArrow(run, schema)
    order = [F.desc("rerank_score"), F.desc("score"), corpus_id]
    scored = scored.drop("rank") if "rank" in scored.columns else scored
    return first_rows(scored, [query_id], order, k, "rank").withColumn("rank", F.col("rank").cast("long"))


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    *,
    minimum_score: float = 0.3,
    scorer: Callable[[list[str], list[str]], np.ndarray] | None = None,
    query_id: str = "query_id",
    corpus_id: str = "vec_id",
    **opts,
) -> DataFrame:
    """Fetch 4·k, drop weak hits, drop repeated ones, rerank, keep k. Both tables carry ``text`` and ``embedding``."""
    hits = _search(queries, corpus, 4 * k, query_id=query_id, corpus_id=corpus_id, **opts)
    full = _with_columns_of(filter_results(hits, minimum_score), opts, corpus.drop("embedding"), corpus_id)
    full = full.join(queries.select(query_id, F.col("text").alias("query_text")), query_id)
    return rerank(dedup.dedupe_hits(full, query_id), k, scorer, query_id=query_id, corpus_id=corpus_id)


def build_context(hits: DataFrame, query_id: str = "query_id", source: str = "source", text: str = "text") -> DataFrame:
    """One prompt context per query from its (at most k) ranked hits."""
    block = F.concat(
        F.lit("[Document "), F.col("rank").cast("string"), F.lit("]\nSource: "),
        F.coalesce(F.col(source), F.lit("Unknown")), F.lit("\n"), F.col(text), F.lit("\n"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy(query_id).agg(
        F.array_join(F.transform(ordered, lambda s: s["block"]), "\n").alias("context"),
        F.count(F.lit(1)).alias("documents"),
    )


def search_document(corpus: DataFrame, document: object, key: str = "doc_id") -> DataFrame:
    return corpus.where(F.col(key) == F.lit(document)).orderBy("chunk_index")


def search_documents(corpus: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chunks of all documents listed in ``documents``."""
    return corpus.join(documents.select(key), key, "left_semi")


def document_ids(corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    return corpus.select(key).distinct()
