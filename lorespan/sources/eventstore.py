"""Event tables in a folder per day: periods read their days alone, and retention drops folders.

``data/day=d/batch=n`` holds what batch ``n`` brought for a day (rows without a time: the null day). A batch that is
repeated after a failure replaces its own folders, so nothing is stored twice. :func:`retain` moves the horizon and deletes
the folders before it; no file is read or rewritten, and batches that come later bring back nothing older.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, IntegerType, StructType

from lorespan.functions.text import col

_DAY = "day"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def days(spark: SparkSession, path: str) -> list[str]:
    """The days that have a folder, in order; one name per day, whatever the number of events."""
    place, files = _folder(spark, f"{path}/data")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(n.removeprefix("day=") for n in names if n.startswith("day=") and "HIVE" not in n)


def horizon(spark: SparkSession, path: str) -> dt.date | None:
    """The first day that is still kept, None if nothing was ever dropped."""
    place, files = _folder(spark, f"{path}/horizon")
    if not files.exists(place):
        return None
    return spark.read.schema("kept_from date").parquet(f"{path}/horizon").agg(F.max("kept_from")).first()[0]


def append(events: DataFrame, path: str, batch: int, ts: str = "created_at") -> None:
    """Store the events of a batch. The number of a batch is its identity: the same number replaces what it stored.

    Days are dealt to tasks by day and a hash of the row, so a day with most of the events is written by several tasks.
    """
    spark = events.sparkSession
    if {_DAY, "batch", "_deal"} & set(events.columns):
        raise ValueError("events have a column of the layout: day, batch or _deal")
    rows = events.withColumn(_DAY, F.to_date(ts)).withColumn("batch", F.lit(batch))
    if (first := horizon(spark, path)) is not None:
        rows = rows.where(F.col(_DAY).isNull() | (F.col(_DAY) >= F.lit(first)))
    _forget(spark, path, batch)
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64(*events.columns), F.lit(8))).repartition(_DAY, "_deal").drop("_deal")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_DAY, "batch").parquet(f"{path}/data")


def _forget(spark: SparkSession, path: str, batch: int) -> None:
    """Remove what an earlier try of the batch stored: a repeated batch may reach other days."""
    place, files = _folder(spark, f"{path}/data/day=*/batch={batch}")
    for status in files.globStatus(place) or []:
        files.delete(status.getPath(), True)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The events, with their ``day``; ``schema`` is that of the events that were appended."""
    place, files = _folder(spark, f"{path}/data")
    full = StructType(list(schema.fields)).add(_DAY, DateType()).add("batch", IntegerType())
    if not files.exists(place):
        return spark.createDataFrame([], full).drop("batch")
    rows = spark.read.schema(full).parquet(f"{path}/data").drop("batch")
    first = horizon(spark, path)
    return rows if first is None else rows.where(F.col(_DAY).isNull() | (F.col(_DAY) >= F.lit(first)))


def between(events: DataFrame, start: Column | str, end: Column | str, ts: str = "created_at") -> DataFrame:
    """Events of ``start <= ts < end``, read from the folders of these days alone."""
    low, high = (F.to_timestamp(F.lit(t)) if isinstance(t, str) else t for t in (start, end))
    inside = (col(ts) >= low) & (col(ts) < high)
    return events.where(inside & (F.col(_DAY) >= F.to_date(low)) & (F.col(_DAY) <= F.to_date(high)))


def on_days(events: DataFrame, calendar: DataFrame, day: str = _DAY) -> DataFrame:
    """Events of the days in ``calendar``, a table of some days and what is known of them, joined by day.

    The days are known only when the query runs; they then prune the folders (dynamic partition pruning).
    """
    chosen = calendar if day == _DAY else calendar.withColumnRenamed(day, _DAY)
    return events.join(chosen, _DAY)


def retain(spark: SparkSession, path: str, as_of: str, keep_days: int = 90) -> list[str]:
    """Drop the folders of days more than ``keep_days`` before ``as_of``; returns those days. Null days stay.

    The horizon is stored first: a run that is stopped between leaves folders that no reader sees, and the next one drops them.
    """
    first = dt.date.fromisoformat(as_of) - dt.timedelta(days=keep_days)
    known = horizon(spark, path)
    first = max(first, known) if known else first
    spark.createDataFrame([(first,)], "kept_from date").coalesce(1).write.mode("append").parquet(f"{path}/horizon")
    gone = [d for d in days(spark, path) if d < first.isoformat()]
    for d in gone:
        place, files = _folder(spark, f"{path}/data/day={d}")
        files.delete(place, True)
    return gone
