"""Tables that change without being rewritten: rows in hash buckets, of which a change writes the touched ones alone.

A table is a folder. ``data/version=n/bucket=b`` holds the whole bucket ``b`` as version ``n`` left it, ``map/version=n``
says for every bucket which version it stands in. A change writes new files for the buckets of its keys, then the map;
readers see the newest map, so they see a change whole or not at all, and older versions stay readable. A change is
given a version number: when it is repeated (a stream's batch after a failure), it starts from the version before it and
writes the same files again. One writer at a time.

Buckets are a number chosen once, so that a bucket stays small: work and files of a change grow with the buckets that it
touches, not with the table.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from lorespan.session import scratch_path

BUCKETS = 64


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def _map(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of every bucket (-1: empty), as of the newest version (below ``before``)."""
    maps = spark.read.schema("bucket int, holds int, version int").parquet(f"{path}/map")
    if before is not None:
        maps = maps.where(F.col("version") < before)
    newest = maps.agg(F.max("version")).first()[0]
    if newest is None:
        return {}
    return {r.bucket: r.holds for r in maps.where(F.col("version") == newest).collect()}  # a row per bucket


def version(spark: SparkSession, path: str) -> int:
    """The newest version."""
    return spark.read.schema("version int").parquet(f"{path}/map").agg(F.max("version")).first()[0]


def _write(rows: DataFrame, path: str, holds: dict[int, int], touched: Sequence[int], number: int, buckets: int) -> None:
    """Write the touched buckets of ``rows`` (with a column ``bucket``) as version ``number``, then the map."""
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
    kept = {b: number if b in touched else holds.get(b, -1) for b in range(buckets)}
    entries = rows.sparkSession.createDataFrame(list(kept.items()), "bucket int, holds int")
    entries.coalesce(1).write.mode("overwrite").parquet(f"{path}/map/version={number}")


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Store ``rows`` (one per key) as version 0 of a new table."""
    spark = rows.sparkSession
    spark.createDataFrame([(buckets, list(keys), rows.schema.json())], "buckets int, keys array<string>, columns string").coalesce(1).write.parquet(f"{path}/table")
    _write(rows.withColumn("bucket", _bucket(keys, buckets)), path, {}, range(buckets), 0, buckets)


def _table(spark: SparkSession, path: str) -> tuple[int, list[str], StructType]:
    r = spark.read.parquet(f"{path}/table").first()
    return r.buckets, list(r["keys"]), StructType.fromJson(json.loads(r.columns))


def _rows(spark: SparkSession, path: str, schema: StructType, holds: dict[int, int]) -> DataFrame:
    """The rows of some buckets; version and bucket are folders, so only those are read."""
    full = StructType(list(schema.fields)).add("version", IntegerType()).add("bucket", IntegerType())
    data = spark.read.schema(full).option("basePath", f"{path}/data").parquet(f"{path}/data")
    by_version: dict[int, list[int]] = {}
    for b, n in holds.items():
        if n >= 0:
            by_version.setdefault(n, []).append(b)
    wanted = F.lit(False)
    for n, own in by_version.items():
        wanted |= (F.col("version") == n) & F.col("bucket").isin(own)
    return data.where(wanted).drop("version")


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The table as it is, or as version ``at`` left it."""
    _, _, schema = _table(spark, path)
    return _rows(spark, path, schema, _map(spark, path, None if at is None else at + 1)).drop("bucket")


def upsert(changes: DataFrame, path: str, order: Sequence[str] = (), number: int | None = None) -> int:
    """Put ``changes`` in the place of rows of equal keys; returns the version.

    With ``order``, the row with the greatest values of these columns wins, stored or new, so late and repeated changes
    are harmless; of several changes of a key the same one does. Without, a change wins over what is stored, and a key
    may be changed once only. Nulls in a key equal each other.
    """
    return _change(changes, path, order, number, False)


def fold(changes: DataFrame, path: str, by: Mapping[str, str], number: int | None = None) -> int:
    """Combine ``changes`` with the rows of equal keys, every other column by its aggregate (``sum``, ``min``, ``max``).

    A fold with a number starts from the version before it, so a repeated one does not add twice.
    """
    return _change(changes, path, (), number, False, by)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or file at ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete(keys: DataFrame, path: str, number: int | None = None) -> int:
    """Remove the rows of these keys; returns the version."""
    return _change(keys, path, (), number, True)


def _change(changes: DataFrame, path: str, order: Sequence[str], number: int | None, removal: bool, by: Mapping[str, str] | None = None) -> int:
    spark = changes.sparkSession
    buckets, keys, schema = _table(spark, path)
    number = version(spark, path) + 1 if number is None else number
    holds = _map(spark, path, number)
    # What changes may be dear to compute and is needed twice: for its buckets and for its rows.
    place = scratch_path(spark, "changes")
    columns = keys if removal else schema.fieldNames()
    changes.select(*columns).withColumn("bucket", _bucket(keys, buckets)).write.parquet(place)
    new = spark.read.parquet(place)
    touched = {r.bucket for r in new.select("bucket").distinct().collect()}
    old = _rows(spark, path, schema, {b: n for b, n in holds.items() if b in touched})
    rest = [c for c in schema.fieldNames() if c not in keys]
    if by is not None:
        parts = [getattr(F, by[c])(c).alias(c) for c in rest]
        merged = old.unionByName(new).groupBy("bucket", *keys).agg(*parts)
    elif order:
        last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
        merged = old.unionByName(new).groupBy("bucket", *keys).agg(last).select("bucket", *keys, "_last.*")
    else:
        same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
        gone = new.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("bucket").alias("_b"))
        merged = old.join(gone, [F.col("bucket") == F.col("_b"), *same], "left_anti")
        merged = merged if removal else merged.unionByName(new)
    _write(merged.select(*schema.fieldNames(), "bucket"), path, holds, sorted(touched), number, buckets)
    return number
