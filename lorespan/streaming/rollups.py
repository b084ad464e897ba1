"""Rollups that grow by increments: partial sums per period and key in a bucket table.

An increment adds up its own rows and folds them into the stored sums; only the buckets of its periods are written. An
increment is a version of the table and starts from the version before it, so repeating it changes nothing. Rows that
are late by their own time correct the period they belong to, however old it is: nothing is closed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorespan.sources import buckettable
from lorespan.sources.buckettable import exists
from lorespan.streaming.forms import drive

UNITS = ("hour", "day", "week", "month", "quarter", "year")


def partial(rows: DataFrame, keys: Sequence[str], measures: Mapping[str, str], at: str, unit: str) -> DataFrame:
    """``period, *keys, n`` and, per measure (name to column), ``name_n``, ``name_sum``, ``name_min``, ``name_max``."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    own: list[Column] = [F.count(F.lit(1)).alias("n")]
    for name, column in measures.items():
        v = F.col(column).cast("double")
        own += [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_sum"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
    return rows.groupBy(F.date_trunc(unit, F.col(at)).alias("period"), *keys).agg(*own)


def folds(columns: Sequence[str], keys: Sequence[str]) -> dict[str, str]:
    """How two partial results of a column become one."""
    return {c: {"min": "min", "max": "max"}.get(c.rsplit("_", 1)[-1], "sum") for c in columns if c not in ("period", *keys)}


def mark(spark: SparkSession, path: str) -> tuple[int, object]:
    """Version and high-water mark of the last finished increment; (0, None) before the first."""
    if not exists(spark, f"{path}/mark"):
        return 0, None
    last = spark.read.parquet(f"{path}/mark").agg(F.max_by(F.struct("version", "high"), "version").alias("m")).first().m
    return last.version, last.high


def increment(
    source: DataFrame,
    path: str,
    arrival: str,
    keys: Sequence[str],
    measures: Mapping[str, str],
    at: str = "created_at",
    unit: str = "day",
    buckets: int = buckettable.BUCKETS,
) -> int:
    """Fold the rows of ``source`` that arrived after the mark into the rollup at ``path``; returns their number.

    ``arrival`` is a column that grows with every row stored (an id, an ingestion time), and says nothing about the time
    ``at`` of the event; the filter on it reaches the scan. Rows without it are refused. The mark is written last: an increment
    that is stopped before starts again from the same mark and the same version.
    """
    spark = source.sparkSession
    number, high = mark(spark, path)
    new = source if high is None else source.where(F.col(arrival).isNull() | (F.col(arrival) > F.lit(high)))
    rows, unplaced, top = new.agg(F.count(F.lit(1)), F.count_if(F.col(arrival).isNull()), F.max(arrival)).first()
    if unplaced:
        raise ValueError(f"{unplaced} rows without {arrival}")
    if not rows:
        return 0
    # What arrives while this runs belongs to the next increment.
    part = partial(new.where(F.col(arrival) <= F.lit(top)), keys, measures, at, unit)
    if not exists(spark, f"{path}/map"):
        buckettable.create(spark.createDataFrame([], part.schema), path, ["period", *keys], buckets)
    buckettable.fold(part, path, folds(part.columns, keys), number + 1)
    done = spark.createDataFrame([(number + 1, top)], ["version", "high"]).withColumn("high", F.col("high").cast(source.schema[arrival].dataType))
    done.coalesce(1).write.mode("append").parquet(f"{path}/mark")
    return rows


def run_rollup(
    events: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    measures: Mapping[str, str],
    at: str = "ts",
    unit: str = "day",
    buckets: int = buckettable.BUCKETS,
) -> None:
    """The same from a stream: a batch is an increment, its number the version."""
    spark = events.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        part = partial(batch, keys, measures, at, unit)
        buckettable.fold(part, path, folds(part.columns, keys), number + 1)

    if not exists(spark, f"{path}/map"):
        empty = partial(spark.createDataFrame([], events.schema), keys, measures, at, unit)
        buckettable.create(empty, path, ["period", *keys], buckets)
    drive(events.writeStream.foreachBatch(add), checkpoint)


def report(spark: SparkSession, path: str, unit: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The stored rollup, or one of coarser periods or fewer keys (``by``) from its partial sums; averages come from sums."""
    stored = buckettable.read(spark, path)
    if unit is not None:
        period = F.date_trunc(unit, "period").alias("period")
        known = [c for c in stored.columns if c == "n" or c.rsplit("_", 1)[-1] in ("n", "sum", "min", "max")]
        parts = [getattr(F, folds([c], ())[c])(c).alias(c) for c in known]
        stored = stored.groupBy(period, *by).agg(*parts)
    names = [c.removesuffix("_sum") for c in stored.columns if c.endswith("_sum")]
    return stored.withColumns({f"{m}_avg": F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sum") / F.col(f"{m}_n")) for m in names})
