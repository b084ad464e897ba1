"""Structured Streaming forms of the usage, session, security and metric operators.

Each function takes a streaming (or batch) DataFrame of events and returns one; ``run_available`` drives a form over
everything that has arrived. Event times must be timestamps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructField, StructType

from lorespan.session import scratch_path
from lorespan.sources import buckettable

# Failed logins per user and day; requests per client, day and hour.
FAILED_LOGINS = 5
LIMITS = {"1 day": 200, "1 hour": 50}


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def usage_windows(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Requests and summed duration per tumbling window and type."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("value").alias("duration"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "requests", "duration")
    )


def latency_windows(
    events: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", delay: str = "1 hour", accuracy: int = 10_000
) -> DataFrame:
    """Mean, maximum and approximate 95th percentile of the latency per sliding window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg("value").alias("average"),
            F.max("value").alias("slowest"),
            F.percentile_approx("value", 0.95, accuracy).alias("p95"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "average", "slowest", "p95")
    )


def failed_login_alerts(events: DataFrame, minimum: int = FAILED_LOGINS, delay: str = "1 hour") -> DataFrame:
    """Users with too many failed logins on a day; meant for update mode, which alerts at once."""
    return (
        events.where("event_type = 'error'")
        .withWatermark("ts", delay)
        .groupBy("user_id", F.window("ts", "1 day"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .where(F.col("failures") >= minimum)
        .select("user_id", F.to_date("window.start").alias("day"), "failures")
    )


def rate_violations(events: DataFrame, window: str, limit: int | None = None, delay: str = "1 hour") -> DataFrame:
    """Clients with more requests per window than allowed."""
    allowed = LIMITS[window] if limit is None else limit
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.window("ts", window))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > allowed)
        .select("user_id", F.col("window.start").alias("start"), "requests")
    )


def user_sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions that close after a pause of ``gap``.

    Do not filter a batch result by the session's start or end: the optimizer pushes such a filter below the merging
    of the events. ``operators.sessions`` is the batch form.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"
        )
    )


def idle_expiry(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """A row when a user has been idle for longer than the gap: a session window ends the gap after its last event."""
    last = F.col("session_window.end") - F.expr(f"interval {gap}")
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", last.alias("last_activity"), "events")
    )


def span_completion(starts: DataFrame, ends: DataFrame, longest: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Join the start and the end record of a span; ``longest`` bounds the state."""
    s = starts.withWatermark("start_time", delay)
    e = ends.withColumnRenamed("span_id", "_span").withWatermark("end_time", delay)
    bound = F.expr(
        f"span_id = _span and end_time >= start_time and end_time <= start_time + interval {longest}"
    )
    took = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000
    return s.join(e, bound).drop("_span").withColumn("duration_ms", F.round(took, 3))


def gauges(events: DataFrame) -> DataFrame:
    """The newest value per name; for update or complete mode."""
    return events.groupBy("event_type").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts")
    )


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Repeated deliveries of an event are dropped as long as they lie within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


@contextmanager
def _state_partitions(spark: SparkSession, number: int | None) -> Iterator[None]:
    """State partitions of a query, fixed when it first starts; the shuffle partitions of the session if not given."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(number or before))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drive(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a stream over everything that has arrived."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_append(form: DataFrame, path: str, checkpoint: str, state_partitions: int | None = None) -> None:
    """Exactly-once append to Parquet of everything that has arrived."""
    with _state_partitions(form.sparkSession, state_partitions):
        q = (
            form.writeStream.format("parquet")
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()


def run_update(form: DataFrame, path: str, checkpoint: str, state_partitions: int | None = None) -> None:
    """Update mode: every batch replaces its own folder, so a repeated batch leaves no second copy."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    with _state_partitions(form.sparkSession, state_partitions):
        q = (
            form.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()


def run_upsert(
    form: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    state_partitions: int | None = None,
    buckets: int = buckettable.BUCKETS,
) -> None:
    """Keep the newest row per key of everything that has arrived in a bucket table at ``path``.

    A batch is a version of the table, so a batch that is repeated after a failure changes nothing, and only the buckets
    of its keys are written. ``order`` decides which row is newest, whatever the order of arrival.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
        rows = batch.groupBy(*keys).agg(newest).select(*keys, "_last.*").select(form.columns)
        buckettable.upsert(rows, path, order, number + 1)

    rest = [c for c in form.columns if c not in keys]
    spark = form.sparkSession
    if not buckettable.exists(spark, f"{path}/map"):
        buckettable.create(spark.createDataFrame([], form.schema), path, keys, buckets)
    with _state_partitions(spark, state_partitions):
        drive(form.writeStream.foreachBatch(merge), checkpoint)


def spans_or_timeout(starts: DataFrame, ends: DataFrame, longest: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Spans with their end; a span that has none within ``longest`` is given once, as timed out, when the watermark passes.

    State holds the starts and ends of the last ``longest`` plus ``delay`` alone.
    """
    s = starts.withWatermark("start_time", delay)
    e = ends.withColumnRenamed("span_id", "_span").withWatermark("end_time", delay)
    bound = F.expr(f"span_id = _span and end_time >= start_time and end_time <= start_time + interval {longest}")
    took = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000
    out = s.join(e, bound, "left_outer").drop("_span").withColumn("duration_ms", F.round(took, 3))
    return out.withColumn("timed_out", F.col("end_time").isNull())


def collect_available(
    form: DataFrame, mode: str, keys: tuple[str, ...] = (), state_partitions: int | None = 8
) -> DataFrame:
    """Drive a form over what has arrived and read the result; in update mode the newest row per key."""
    spark = form.sparkSession
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    if mode == "append":
        run_append(form, path, checkpoint, state_partitions)
        return spark.read.schema(form.schema).parquet(path)
    run_update(form, path, checkpoint, state_partitions)
    rows = spark.read.schema(StructType([*form.schema.fields, StructField("_batch", IntegerType())])).parquet(path)
    rest = [c for c in form.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s")).select(*keys, "_s.*")
