"""Vector arithmetic, encoders and vector tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from lorespan.functions import text as t
from lorespan.functions.text import let


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), term), F.lit(0.0), lambda s, x: s + x)


def dot_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot_product(a, b) / n))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def normalize_vector(v: Column, length: Column | None = None) -> Column:
    """Divided by its length (``length``, if it is known); a zero vector stays as it is."""
    length = norm(v) if length is None else length
    return let(length, lambda n: F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n)))


def validate_vectors(df: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Add ``valid``: the vector has the dimension and only finite numbers."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.withColumn("valid", F.coalesce((F.size(v) == dimension) & finite, F.lit(False)))


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str = "embedding", name: str = "mean") -> DataFrame:
    """Element-wise mean per key. Positions are summed on the map side, so only one row per key and position moves."""
    means = (
        df.select(*by, F.posexplode(_double(F.col(vector))).alias("_i", "_x"))
        .groupBy(*by, "_i")
        .agg(F.avg("_x").alias("_x"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_x")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda s: s["_x"]).alias(name))


def collection_statistics(df: DataFrame, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.max(F.size(vector)).cast("long").alias("dimension"),
        F.lit(metric).alias("metric"),
    )


# Encoders --------------------------------------------------------------------------------------------------------


def _as_float_lists(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix, dtype=np.float64)
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1] if matrix.ndim == 2 and matrix.shape[1] else 1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel()))


def embed(
    df: DataFrame,
    encoder: Callable[[list[str]], np.ndarray],
    text: str = "text",
    name: str = "embedding",
    normalize: bool = True,
) -> DataFrame:
    """Encode a text column with the caller's batch function ``list of texts -> matrix``.

    It is called once per Arrow batch inside the tasks; the encoder is built wherever the function builds it.
    """
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            if not texts:
                continue
            m = np.asarray(encoder(texts), dtype=np.float64)
            if normalize:
                lengths = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, lengths, out=m.copy(), where=lengths > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, _as_float_lists(m)], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def word_buckets(c: Column, dimension: int) -> Column:
    """Hash bucket of every normalised word, from the leading digits of its MD5."""
    return F.transform(
        t.tokens(c),
        lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dimension).cast("int"),
    )


def hashed_embedding(df: DataFrame, text: str = "text", name: str = "embedding", dimension: int = 64) -> DataFrame:
    """The built-in encoder: unit vectors of hashed word counts.

    Words are hashed in the JVM; the counting of a whole batch is one ``bincount``.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def count(buckets: pd.Series) -> pd.Series:
        sizes = np.array([0 if b is None else len(b) for b in buckets], dtype=np.int64)
        total = len(buckets)
        if not sizes.sum():
            return pd.Series([np.zeros(dimension) for _ in range(total)])
        flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in buckets if b is not None and len(b)])
        rows = np.repeat(np.arange(total), sizes)
        m = np.bincount(rows * dimension + flat, minlength=total * dimension).reshape(total, dimension).astype(float)
        lengths = np.linalg.norm(m, axis=1, keepdims=True)
        return pd.Series(list(np.divide(m, lengths, out=m, where=lengths > 0)))

    return df.withColumn(name, count(word_buckets(F.col(text), dimension)))


# Vector tables ---------------------------------------------------------------------------------------------------


def chunk_id(document: str = "doc_id", index: str = "chunk_index") -> Column:
    """A stable id in place of a random one, so that re-running a load adds nothing twice."""
    return F.sha2(F.concat_ws(":", F.col(document).cast("string"), F.col(index).cast("string")), 256)


def add_vectors(store: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows of ``new`` whose key is not yet stored are appended."""
    return store.unionByName(new.join(store.select(key), key, "left_anti"))


def upsert_vectors(store: DataFrame, changed: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows of ``changed`` replace those of the same key."""
    return store.join(changed.select(key), key, "left_anti").unionByName(changed)


def write_version(store: DataFrame, path: str) -> str:
    """Store a new version of a collection next to the earlier ones, and return its place.

    Readers of an older version are not disturbed, and a write that fails leaves nothing that is read.
    """
    place = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    store.write.parquet(place)
    return place


def delete_vectors(store: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def get_vectors(store: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return store.join(ids.select(key), key, "left_semi")


def float_vector(c: Column) -> Column:
    return c.cast(ArrayType(FloatType()))
