"""What the operators of this package share: stored tables, connected components, whole-batch Python steps."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorespan.session import scratch_path

#: Documents that a Python step turns into arrays at a time, and the bytes at which it stops earlier.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and a lost executor costs one task."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator in the shared folder, which go once they have been read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.last = spark, [], []

    def keep(self, path: str, last: bool = False) -> None:
        (self.last if last else self.paths).append(path)

    def stored(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        """Like :func:`stored`; with ``last``, the table belongs to the result and stays."""
        path = scratch_path(self.spark, name)
        self.keep(path, last)
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        return self.spark.read.schema(schema).parquet(path)

    def sweep(self, files: bool = False) -> None:
        """Let Spark's cleaner take the shuffle files of finished queries, and with ``files`` delete the tables.

        The cleaner removes them when the driver's memory is collected, which a large heap puts off for long.
        """
        gc.collect()
        self.spark._jvm.System.gc()
        for path in self.paths if files else ():
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def keyed(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with columns ``c0, c1, ...`` and two hashes ``k, l`` of id and text, and the names of id and text in it.

    Rows are told apart by the hashes: they need no copy of the table, and only truly repeated rows (of equal id and
    text) share them. No name of an input column can clash with one of a step's own.
    """
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id, text))
    hashes = {"k": F.xxhash64(own_text, own_id), "l": F.xxhash64(own_id, F.lit(0), own_text)}
    return docs.select(*columns).withColumns(hashes), own_id, own_text


#: What this worker process remembers between tasks, by kind of step, and how it is forgotten.
_remembered: dict[str, Callable[[], None]] = {}


def remembers(step: str, forget: Callable[[], None]) -> None:
    """A kind of step says that it remembers things between tasks; what other kinds have left in this worker goes.

    Spark hands its Python workers from one step to the next. Without this they would hold the memories of all steps.
    """
    others = [s for s in _remembered if s != step]
    for other in others:
        _remembered.pop(other)()
    if others:
        gc.collect()
    _remembered[step] = forget


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches into pieces of bounded rows and bytes, each with the values of one column."""
    for batch in batches:
        column = batch.column(text)
        values, first, size = [], 0, 0
        for i in range(len(column)):
            value = column[i].as_py()
            values.append(value)
            size += len(value) if value else 0
            if len(values) == SLICE_ROWS or size >= SLICE_BYTES:
                yield batch.slice(first, len(values)), values
                values, first, size = [], i + 1, 0
        if values:
            yield batch.slice(first, len(values)), values


def arrow_step(df: DataFrame, text: str, schema: StructType | str, step: Callable) -> DataFrame:
    """Run ``step(batch, values)`` over bounded slices of ``df``; it returns the columns of ``schema`` in order."""
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = target.fieldNames()
        for batch, values in slices(batches, text):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in step(batch, values)], names)

    return df.mapInArrow(run, target)


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "component", scratch: Scratch | None = None) -> DataFrame:
    """Connected components of an edge list as ``node, <name>``; the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes: every step is a grouped minimum and a join, its
    output never exceeds its input, and the number of rounds grows with the logarithm of the longest chain. Each
    round is stored (in ``scratch``, if given). Nodes without an edge (and edges with a null end) are not in the result.
    """
    stored_ = scratch.stored if scratch else stored
    low, high = F.least(a, b), F.greatest(a, b)
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored_(pairs.select(high.alias("u"), low.alias("v")).distinct(), "edges")
    before = _signature(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored_(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias(name))
    return now.select(F.col("u").alias("node"), F.col("v").alias(name)).union(roots)
