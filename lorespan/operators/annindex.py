"""Approximate nearest neighbours: a stored index of random-projection buckets, multi-probe search, exact scores.

An index is a folder of two tables. ``planes`` holds the hyperplanes of every hash table with the threshold at which
each cuts its projections in half; thresholds come from a bounded sample. ``rows`` holds every vector once per hash
table, by bucket: one bit per plane. Planes are few and fit the driver; rows are never brought there.

A search hashes the queries with the stored planes and looks into each query's own bucket and those it nearly fell into.
What it finds is scored exactly, so scores and order are those of exact search; only neighbours that share no probed
bucket are missing. More tables or probes find more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lorespan.operators.retrieve import _arrow_schema, _comparable, _hits, _matrix, _Side, _table
from lorespan.operators.skew import first_rows

TABLES, BITS, PROBES = 6, 4, 6
#: Rows of the corpus that thresholds are fitted on: those with the smallest hash of their id.
SAMPLE = 4096
#: Vectors of a bucket, and queries, that meet in one task.
BLOCK_ROWS = 8192
#: Bits of a hash table, at most: its buckets are counted in one small table.
MOST_BITS = 16
SEED = 7


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """``tables * bits`` unit normals; those of a table are at right angles where the dimension allows."""
    rng = np.random.default_rng([seed, dim])
    found = []
    for _ in range(tables):
        normals = rng.standard_normal((bits, dim))
        if bits <= dim:
            normals = np.linalg.qr(normals.T)[0].T
        found.append(normals / np.linalg.norm(normals, axis=1, keepdims=True))
    return np.concatenate(found)


def _unit_rows(column) -> np.ndarray:
    m = _matrix(column)
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


class Planes:
    """Hyperplanes of all tables, as stored."""

    def __init__(self, normals: np.ndarray, cuts: np.ndarray, tables: int):
        self.normals, self.cuts, self.tables, self.bits = normals, cuts, tables, len(cuts) // max(tables, 1)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Planes:
        rows = sorted(spark.read.parquet(f"{path}/planes").collect(), key=lambda r: (r.table, r.bit))
        return Planes(np.array([r.normal for r in rows]), np.array([r.cut for r in rows]), rows[-1].table + 1 if rows else 0)

    def margins(self, units: np.ndarray) -> np.ndarray:
        """How far each row lies beyond each plane: rows, tables, bits."""
        return (units @ self.normals.T - self.cuts).reshape(len(units), self.tables, self.bits)

    def buckets(self, units: np.ndarray) -> np.ndarray:
        return (self.margins(units) >= 0) @ (1 << np.arange(self.bits))

    def probes(self, units: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` likeliest buckets of each row and table, its own first.

        A neighbour falls on the other side of a plane the more easily, the nearer the row lies to it: sets of planes
        are taken by the sum of their squared margins.
        """
        margins = self.margins(units)
        own = (margins >= 0) @ (1 << np.arange(self.bits))
        near = np.argsort(np.abs(margins), axis=2)[:, :, : min(self.bits, 8)]
        cost = np.take_along_axis(margins, near, axis=2) ** 2
        sets = (np.arange(1 << near.shape[2])[:, None] >> np.arange(near.shape[2])) & 1
        best = np.argsort(cost @ sets.T, axis=2, kind="stable")[:, :, :n]
        flips = (sets[best] * (1 << near)[:, :, None, :]).sum(axis=3)
        return own[:, :, None] ^ flips


def build(
    corpus: DataFrame,
    path: str,
    tables: int = TABLES,
    bits: int = BITS,
    *,
    corpus_id: str = "vec_id",
    vector: str = "embedding",
    seed: int = SEED,
) -> None:
    """Write an index of all full vectors of ``corpus`` to ``path``; vectors with missing parts cannot be found.

    All vectors have one length. ``bits`` should grow with the logarithm of the corpus, so that a bucket stays a few
    thousand rows; ``tables`` is the number of copies of the vectors.
    """
    if not 1 <= bits <= MOST_BITS or tables < 1:
        raise ValueError(f"give at least one table and 1 to {MOST_BITS} bits")
    spark = corpus.sparkSession
    full = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    sample = corpus.where(full).orderBy(F.xxhash64(corpus_id)).limit(SAMPLE).select(F.col(vector).cast("array<double>").alias("v"))
    held = np.array([r.v for r in sample.toLocalIterator()], dtype=np.float64)
    dim = held.shape[1] if held.ndim == 2 else 1
    normals = _planes(dim, tables, bits, seed)
    lengths = np.linalg.norm(held, axis=1, keepdims=True) if held.ndim == 2 else None
    cuts = np.median(held / np.maximum(lengths, 1e-300) @ normals.T, axis=0) if len(held) else np.zeros(len(normals))
    stored = [(k // bits, k % bits, n.tolist(), float(c)) for k, (n, c) in enumerate(zip(normals, cuts))]
    shape = "`table` int, bit int, normal array<double>, cut double"
    spark.createDataFrame(stored, shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")
    _hashed(corpus, Planes(normals, cuts, tables), corpus_id, vector).write.mode("overwrite").parquet(f"{path}/rows")


def add(rows: DataFrame, path: str, *, corpus_id: str = "vec_id", vector: str = "embedding") -> None:
    """Append vectors to an index, under its own planes; what is stored already is not touched."""
    planes = Planes.read(rows.sparkSession, path)
    _hashed(rows, planes, corpus_id, vector).write.mode("append").parquet(f"{path}/rows")


def _hashed(corpus: DataFrame, planes: Planes, corpus_id: str, vector: str) -> DataFrame:
    """``id, embedding, table, bucket``: a row per vector and hash table, together by bucket."""
    side = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _comparable(batch, "embedding")
            if not part.num_rows:
                continue
            lists = planes.buckets(_unit_rows(part.column("embedding"))).astype(np.int32)
            ends = pa.array(np.arange(len(lists) + 1) * planes.tables, pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(lists.ravel()))], ["id", "embedding", "buckets"])

    kind = side.schema["id"].dataType.simpleString()
    found = side.mapInArrow(run, f"id {kind}, embedding array<double>, buckets array<int>")
    found = found.select("id", "embedding", F.posexplode("buckets").alias("table", "bucket"))
    return found.repartition("table", "bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("table", "bucket")


def search(
    queries: DataFrame,
    path: str,
    k: int = 10,
    probes: int = PROBES,
    *,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    corpus_id: str = "vec_id",
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query id, corpus id, score, rank``: the ``k`` best by cosine of what the probed buckets hold.

    ``probes`` buckets of each hash table are looked into. Buckets of more than ``block_rows`` vectors are cut by a hash
    of the id and queries by theirs, so a task compares bounded blocks; a block gives back its ``k`` best per query.
    Ties go to the smaller id; a query whose buckets hold fewer than ``k`` vectors gets fewer hits.
    """
    if k <= 0 or probes <= 0:
        raise ValueError("k and probes must be greater than zero")
    spark = queries.sparkSession
    planes = Planes.read(spark, path)
    rows = spark.read.parquet(f"{path}/rows")
    side = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("embedding"))
    kind = side.schema["q"].dataType.simpleString()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _comparable(batch, "embedding")
            if not part.num_rows:
                continue
            found = planes.probes(_unit_rows(part.column("embedding")), probes)
            flat = (found + (np.arange(planes.tables) << MOST_BITS)[None, :, None]).reshape(len(found), -1).astype(np.int32)
            ends = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], ["q", "embedding", "at"])

    # A row per table and bucket: at most tables * 2^bits.
    sizes = rows.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    q_blocks = max(1, -(-queries.count() // block_rows))
    left = side.mapInArrow(asked, f"q {kind}, embedding array<double>, at array<int>").select("q", "embedding", F.explode("at").alias("at"))
    left = left.select("q", "embedding", F.shiftright("at", MOST_BITS).alias("table"), F.col("at").bitwiseAND(F.lit((1 << MOST_BITS) - 1)).alias("bucket"))
    left = left.join(F.broadcast(sizes), ["table", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(q_blocks)).cast("int")).drop("parts")
    right = rows.join(F.broadcast(sizes), ["table", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).drop("parts")
    out = StructType([StructField("_q", side.schema["q"].dataType), StructField("_c", rows.schema["id"].dataType), StructField("score", DoubleType())])
    schema = _arrow_schema(out)
    args = dict(metric="cosine", k=k, min_score=None, alpha=None, exclude_self=exclude_self)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        mine = _Side(a, "q", "embedding")
        r, i, s = _hits(mine, _Side(b, "id", "embedding"), args)
        return pa.Table.from_batches([_table(r, i, s, mine.ids, schema)])

    keys = ["table", "bucket", "part", "block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, out)
    # A neighbour is met once per shared bucket, each time with the same score.
    hits = first_rows(hits.dropDuplicates(["_q", "_c"]), ["_q"], [F.desc("score"), F.col("_c")], k, "rank")
    return hits.select(F.col("_q").alias(query_id), F.col("_c").alias(corpus_id), "score", F.col("rank").cast("long").alias("rank"))


def recall(found: DataFrame, exact: DataFrame, *, query_id: str = "query_id", corpus_id: str = "vec_id") -> DataFrame:
    """One row: ``queries``, ``hits`` of the exact search, ``recall`` (share of them found), ``scores_equal``.

    Scores of hits that both have must be the same; a hit that exact search does not have counts for neither.
    """
    both = exact.select(query_id, corpus_id, F.col("score").alias("true_score")).join(
        found.select(query_id, corpus_id, "score"), [query_id, corpus_id], "left"
    )
    return both.agg(
        F.count_distinct(query_id).alias("queries"),
        F.count(F.lit(1)).alias("hits"),
        F.avg(F.col("score").isNotNull().cast("double")).alias("recall"),
        F.coalesce(F.every(F.col("score").isNull() | (F.abs(F.col("score") - F.col("true_score")) < 2e-9)), F.lit(True)).alias("scores_equal"),
    )
