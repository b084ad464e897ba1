"""Streaming queries over the events table, compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorespan.plans.registry import query
from lorespan.session import scratch_path
from lorespan.sources import buckettable, eventstore
from lorespan.sources.tables import table
from lorespan.streaming import forms as f, keyed, rollups

_CLOSED = "(select max(ts) - interval 1 hour from events)"


def stream(spark: SparkSession, root: str) -> DataFrame:
    """The table as a stream. Written as a pattern, the path may be a single file as well as a folder of files."""
    schema = table(spark, root, "events").schema
    return f.event_stream(spark, f"{root.rstrip('/')}/events.parque[t]", schema)


@query(
    "stream_usage_daily",
    272,
    284,
    sql="""select date_trunc('day', ts)::timestamp as start, date_trunc('day', ts)::timestamp + interval 1 day as "end",
    event_type, count(*) as requests, round(sum(value), 4) as duration from events group by all""",
)
def stream_usage_daily(spark: SparkSession, root: str) -> DataFrame:
    out = f.collect_available(f.usage_windows(stream(spark, root)), "update", ("start", "end", "event_type"))
    return out.withColumn("duration", F.round("duration", 4))


@query(
    "stream_usage_closed",
    272,
    sql=f"""select * from (select date_trunc('hour', ts)::timestamp as start, date_trunc('hour', ts)::timestamp + interval
    1 hour as "end", event_type, count(*) as requests, round(sum(value), 4) as duration from events group by all)
    where "end" <= {_CLOSED}""",
)
def stream_usage_closed(spark: SparkSession, root: str) -> DataFrame:
    """Append mode: only windows that the watermark has passed."""
    out = f.collect_available(f.usage_windows(stream(spark, root), "1 hour"), "append")
    return out.withColumn("duration", F.round("duration", 4))


@query(
    "stream_latency",
    313,
    sql=f"""with w as (select unnest([time_bucket(interval 5 minute, ts), time_bucket(interval 5 minute, ts)
    - interval 5 minute]) as start, value from events) select * from (select start::timestamp as start,
    start::timestamp + interval 10 minute as "end", count(*) as requests, round(avg(value), 6) as average,
    max(value) as slowest, quantile_disc(value, 0.95) as p95 from w group by start) where "end" <= {_CLOSED}""",
)
def stream_latency(spark: SparkSession, root: str) -> DataFrame:
    out = f.collect_available(f.latency_windows(stream(spark, root)), "append")
    return out.withColumn("average", F.round("average", 6))


@query(
    "stream_failed_logins",
    297,
    sql="""select user_id, ts::date as day, count(*) as failures from events where event_type = 'error'
    group by all having count(*) >= 3""",
)
def stream_failed_logins(spark: SparkSession, root: str) -> DataFrame:
    return f.collect_available(f.failed_login_alerts(stream(spark, root), 3), "update", ("user_id", "day"))


@query(
    "stream_rate_violations",
    313,
    sql="""select user_id, date_trunc('day', ts)::timestamp as start, count(*) as requests from events group by all
    having count(*) > 5""",
)
def stream_rate_violations(spark: SparkSession, root: str) -> DataFrame:
    return f.collect_available(f.rate_violations(stream(spark, root), "1 day", 5), "update", ("user_id", "start"))


_SESSIONS = """g as (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour,
    true)::int as fresh from events), n as (select *, sum(fresh) over (partition by user_id order by ts, event_id)
    as session_no from g), s as (select user_id, min(ts) as start, max(ts) as last, max(ts) + interval 6 hour as "end",
    count(*) as events from n group by user_id, session_no)"""


@query("stream_sessions", 289, sql=f"""with {_SESSIONS} select user_id, start, "end", events from s where "end" <= {_CLOSED}""")
def stream_sessions(spark: SparkSession, root: str) -> DataFrame:
    return f.collect_available(f.user_sessions(stream(spark, root)), "append")


@query(
    "stream_idle_expiry",
    289,
    288,
    sql=f"""with {_SESSIONS} select user_id, last as last_activity, events from s where "end" <= {_CLOSED}""",
)
def stream_idle_expiry(spark: SparkSession, root: str) -> DataFrame:
    return f.collect_available(f.idle_expiry(stream(spark, root)), "append")


@query(
    "stream_span_completion",
    302,
    sql="""select event_id as span_id, ts as start_time, make_timestamp(epoch_us(ts) + round(value * 1000)::bigint)
    as end_time, round(round(value * 1000) / 1000, 3) as duration_ms from events""",
)
def stream_span_completion(spark: SparkSession, root: str) -> DataFrame:
    end = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long"))
    starts = stream(spark, root).select(F.col("event_id").alias("span_id"), F.col("ts").alias("start_time"))
    ends = stream(spark, root).select(F.col("event_id").alias("span_id"), end.alias("end_time"))
    return f.collect_available(f.span_completion(starts, ends), "append")


@query(
    "stream_span_timeout",
    302,
    sql=f"""with s as (select event_id, ts, case when event_type <> 'error' then make_timestamp(epoch_us(ts) + round(value * 1000)::bigint) end as ended from events)
    select event_id as span_id, ts as start_time, ended as end_time,
    case when ended is not null then round((epoch_us(ended) - epoch_us(ts)) / 1000, 3) end as duration_ms, ended is null as timed_out
    from s where ended is not null or ts + interval 1 hour < (select least(max(ts), max(ended)) from s) - interval 1 hour""",
)
def stream_span_timeout(spark: SparkSession, root: str) -> DataFrame:
    """Spans of which those of errors never end: they come once, as timed out."""
    end = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long"))
    starts = stream(spark, root).select(F.col("event_id").alias("span_id"), F.col("ts").alias("start_time"))
    ends = stream(spark, root).where("event_type <> 'error'").select(F.col("event_id").alias("span_id"), end.alias("end_time"))
    return f.collect_available(f.spans_or_timeout(starts, ends), "append")


@query(
    "stream_upsert_latest",
    255,
    290,
    293,
    sql="select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id",
)
def stream_upsert_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest event per user, kept in a table of buckets over four batches that come in no order of time."""
    parts, path = scratch_path(spark, "events"), scratch_path(spark, "latest")
    table(spark, root, "events").select("user_id", "event_id", "ts", "event_type").repartition(4, "event_id").write.parquet(parts)
    events = f.event_stream(spark, parts, spark.read.parquet(parts).schema, 1)
    f.run_upsert(events, path, scratch_path(spark, "checkpoint"), ["user_id"], ["ts", "event_id"], 8, 8)
    return buckettable.read(spark, path)


@query(
    "stream_gauges",
    307,
    sql="select event_type, arg_max(value, (ts, event_id)) as value, max(ts) as ts from events group by event_type",
)
def stream_gauges(spark: SparkSession, root: str) -> DataFrame:
    return f.collect_available(f.gauges(stream(spark, root)), "update", ("event_type",))


@query("stream_deduplicated", 265, sql="select event_id, ts, user_id from events")
def stream_deduplicated(spark: SparkSession, root: str) -> DataFrame:
    """Every event delivered twice; also the exactly-once append sink."""
    twice = stream(spark, root).unionByName(stream(spark, root))
    return f.collect_available(f.deduplicated(twice).select("event_id", "ts", "user_id"), "append")


@query("stream_append_events", 265, 292, sql="select event_id, ts, user_id, event_type, value, props from events")
def stream_append_events(spark: SparkSession, root: str) -> DataFrame:
    return f.collect_available(stream(spark, root), "append")


@query(
    "stream_idle_sessions",
    288,
    289,
    sql="""with g as (select *, coalesce(ts >= lag(ts) over w + interval 6 hour, true)::int as opens from events
    window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from g)
    select user_id, min(ts) as first_activity, max(ts) as last_activity, count(*) as events, max(ts) + interval 6 hour
    as expired_at from s group by user_id, n
    having max(ts) + interval 6 hour <= (select date_trunc('millisecond', max(ts)) - interval 1 hour from events)""",
)
def stream_idle_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions that a timer has closed."""
    with keyed.rocks(spark):
        return f.collect_available(keyed.idle_sessions(stream(spark, root)), "append", state_partitions=None)


@query(
    "stream_rate_limited",
    297,
    313,
    sql="""with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as i
    from events), r as (select user_id, event_id, ts, i, true as allowed, [ts] as kept from e where i = 1 union all
    select e.user_id, e.event_id, e.ts, e.i, len(list_filter(r.kept, lambda x: x > e.ts - interval 1 day)) < 2,
    case when len(list_filter(r.kept, lambda x: x > e.ts - interval 1 day)) < 2
    then list_append(list_filter(r.kept, lambda x: x > e.ts - interval 1 day), e.ts) else r.kept end
    from r join e on e.user_id = r.user_id and e.i = r.i + 1) select user_id, event_id, ts, allowed from r""",
)
def stream_rate_limited(spark: SparkSession, root: str) -> DataFrame:
    """Two requests per user in any 24 hours; the rest is refused and does not count."""
    with keyed.rocks(spark):
        return f.collect_available(keyed.rate_limited(stream(spark, root), 2), "append", state_partitions=None)


_MEASURED = """count(*) as n, count(value) as value_n, round(sum(value), 4) as value_sum, min(value) as value_min, max(value) as value_max,
    round(avg(value), 6) as value_avg from events group by all"""


def _rounded(report: DataFrame) -> DataFrame:
    return report.withColumn("value_sum", F.round("value_sum", 4)).withColumn("value_avg", F.round("value_avg", 6))


@query(
    "incremental_rollup",
    279,
    284,
    285,
    sql=f"select date_trunc('day', ts)::timestamp as period, event_type, {_MEASURED}",
)
def incremental_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Daily usage from three increments of a source that grows, each from the mark of the one before.

    Events arrive in the order of a hash of their ids, so every increment brings late ones for days already rolled up.
    """
    path = scratch_path(spark, "rollup")
    arrived = F.pmod(F.xxhash64("event_id"), F.lit(1 << 40))
    events = table(spark, root, "events").withColumn("arrived", arrived)
    for third in (1, 2, 3):
        there = events.where(F.col("arrived") < (1 << 40) // 3 * third + third // 3)
        rollups.increment(there, path, "arrived", ["event_type"], {"value": "value"}, "ts", buckets=8)
    return _rounded(rollups.report(spark, path))


@query(
    "stream_rollup",
    272,
    284,
    285,
    sql=f"select date_trunc('month', ts)::timestamp as period, event_type, {_MEASURED}",
)
def stream_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Hourly sums kept by a stream of four batches in no order of time, read by month."""
    parts, path = scratch_path(spark, "events"), scratch_path(spark, "rollup")
    table(spark, root, "events").select("event_id", "ts", "event_type", "value").repartition(4, "event_id").write.parquet(parts)
    events = f.event_stream(spark, parts, spark.read.parquet(parts).schema, 1)
    rollups.run_rollup(events, path, scratch_path(spark, "checkpoint"), ["event_type"], {"value": "value"}, unit="hour", buckets=8)
    return _rounded(rollups.report(spark, path, "month", ["event_type"]))


def _stored_events(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The events by day, in two batches of which the second came twice."""
    events = table(spark, root, "events")
    halves = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for batch in (0, 1, 1):
        eventstore.append(events.where(halves == batch), path, batch, "ts")
    return eventstore.read(spark, path, events.schema)


@query(
    "event_store_period",
    280,
    sql="select event_id, user_id, ts from events where ts >= '2024-01-10' and ts < '2024-01-12 12:00:00'",
)
def event_store_period(spark: SparkSession, root: str) -> DataFrame:
    stored = _stored_events(spark, root, scratch_path(spark, "store"))
    return eventstore.between(stored, "2024-01-10", "2024-01-12 12:00:00", "ts").select("event_id", "user_id", "ts")


@query(
    "event_store_retention",
    281,
    299,
    sql="select ts::date as day, event_type, count(*) as events from events where ts::date >= '2024-01-31'::date - 14 group by all",
)
def event_store_retention(spark: SparkSession, root: str) -> DataFrame:
    """Days of the last two weeks; the folders before them are gone, and a batch that comes again brings none back."""
    path = scratch_path(spark, "store")
    schema = _stored_events(spark, root, path).drop("day").schema
    eventstore.retain(spark, path, "2024-01-31", 14)
    events = table(spark, root, "events")
    eventstore.append(events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0), path, 0, "ts")
    kept = eventstore.read(spark, path, schema)
    return kept.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "event_store_busy_days",
    280,
    sql="""with c as (select ts::date as day, count(*) as errors from events where event_type = 'error' group by 1),
    b as (select * from c where errors > (select avg(errors) from c)) select day, errors, count(*) as events, count(distinct user_id) as users
    from events join b on ts::date = day group by all""",
)
def event_store_busy_days(spark: SparkSession, root: str) -> DataFrame:
    """What happened on days with more errors than on average: days known at run time prune the folders."""
    stored = _stored_events(spark, root, scratch_path(spark, "store"))
    errors = stored.where("event_type = 'error'").groupBy("day").agg(F.count(F.lit(1)).alias("errors"))
    busy = errors.where(F.col("errors") > errors.agg(F.avg("errors")).scalar())
    joined = eventstore.on_days(stored, busy)
    return joined.groupBy("day", "errors").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))
