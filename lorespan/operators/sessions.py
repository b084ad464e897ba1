"""Sessions, logins, devices and security events. Every rule takes the time it judges by as an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.operators.skew import first_rows, prefix_sums, previous_value, side_by_side
from lorespan.operators.usage import retain

# Fixed value: failed logins per user and day that raise an alert.
FAILED_LOGINS = 5


def as_time(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def sessionize(
    events: DataFrame,
    gap: str = "6 hours",
    user: str = "user_id",
    ts: str = "ts",
    tie: str = "event_id",
    bucket: str = "hour",
) -> DataFrame:
    """Number the sessions of every user: a pause longer than ``gap`` starts a new one.

    Works hour by hour (``bucket``) with carried ends, so that one busy user is spread over all their hours.
    """
    cell = F.date_trunc(bucket, ts)
    seen = previous_value(events, [user], [ts, tie], cell, ts, "_previous")
    fresh = F.coalesce(F.col(ts) > F.col("_previous") + F.expr(f"interval {gap}"), F.lit(True))
    flagged = seen.withColumn("_new", fresh.cast("long"))
    return prefix_sums(flagged, [user], [ts, tie], cell, {"session_no": F.col("_new")}).drop("_previous", "_new")


def session_table(numbered: DataFrame, ttl: str = "1 day", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """One row per session with first and last activity, number of events and expiry."""
    return (
        numbered.groupBy(user, "session_no")
        .agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("events"))
        .withColumn("expires_at", F.col("last_activity") + F.expr(f"interval {ttl}"))
    )


def expire(sessions: DataFrame, as_of: str | Column) -> DataFrame:
    """Sessions past their expiry become inactive."""
    return sessions.withColumn("is_active", F.col("expires_at") >= as_time(as_of))


def active_sessions(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sessions.groupBy(*by).agg(
        F.count_if("is_active").alias("active"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_active")).alias("expired"),
    )


def session_statistics(sessions: DataFrame, user: str = "user_id") -> DataFrame:
    return sessions.where("is_active").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct(user).alias("users")
    )


def _seconds(later: Column, earlier: Column) -> Column:
    return F.round((F.unix_micros(later) - F.unix_micros(earlier)) / 1e6, 2)


def idle_times(sessions: DataFrame, as_of: str | Column) -> DataFrame:
    """Seconds since the last activity and since the start."""
    now = as_time(as_of)
    return sessions.withColumn("idle_seconds", _seconds(now, F.col("last_activity"))).withColumn(
        "duration_seconds", _seconds(now, F.col("created_at"))
    )


def last_activity(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(key).agg(F.max(ts).alias("last_activity"))


def active_conversations(rows: DataFrame, session: str, conversation: str, order: Sequence[str]) -> DataFrame:
    """The conversation set last per session."""
    return rows.groupBy(session).agg(
        F.max_by(conversation, F.struct(*order)).alias("conversation"), F.max(order[0]).alias("updated_at")
    )


def login_history(logins: DataFrame, limit: int = 20, user: str = "user_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    return first_rows(logins, [user], [F.desc(c) for c in order], limit, "recency").withColumn(
        "recency", F.col("recency").cast("long")
    )


def logins_by(logins: DataFrame, column: str) -> DataFrame:
    """Logins by device, browser or any other attribute."""
    return logins.groupBy(column).agg(F.count(F.lit(1)).alias("logins"))


def logout(sessions: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Close the sessions listed in ``gone`` (by session or by user)."""
    listed = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return sessions.join(listed, list(keys), "left").withColumn(
        "is_active", F.col("is_active") & F.col("_gone").isNull()
    ).drop("_gone")


def remove(sessions: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sessions.join(gone.select(*keys), list(keys), "left_anti")


def trusted_devices(devices: DataFrame, revoked: DataFrame, key: str = "device_id") -> DataFrame:
    return devices.where("trusted").join(revoked.select(key), key, "left_anti")


def failed_login_alerts(failures: DataFrame, minimum: int = FAILED_LOGINS, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Users with too many failed logins on one day."""
    return (
        failures.groupBy(user, F.to_date(ts).alias("day"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .where(F.col("failures") >= minimum)
        .withColumn("severity", F.lit("HIGH"))
        .withColumn("description", F.lit("Too many failed logins"))
    )


def security_statistics(failures: DataFrame, alerts: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return side_by_side(n(failures, "failed_logins"), n(alerts, "security_alerts"))


def cleanup(tables: dict[str, tuple[DataFrame, str]], as_of: str, days: int = 90) -> dict[str, DataFrame]:
    """Retention of several tables, each by its own time column."""
    return {name: retain(df, as_of, days, ts) for name, (df, ts) in tables.items()}
