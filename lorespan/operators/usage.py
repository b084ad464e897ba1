"""Tokens, cost and usage of requests.

A usage row holds ``user_id, conversation_id, provider, model, created_at, duration_ms`` and four token counts.
Everything is a partial and final aggregate; reports that need several groupings share one pre-aggregated table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.skew import side_by_side

# Prices per 1000 tokens by provider; the token counts of a usage row.
PRICES = {
    "openai": 0.005,
    "anthropic": 0.008,
    "google": 0.002,
    "mistral": 0.003,
    "cohere": 0.001,
    "qwen": 0.001,
    "ollama": 0.0,
    "custom": 0.0,
}
TOKEN_KINDS = ("prompt_tokens", "completion_tokens", "embedding_tokens", "cached_tokens")
PERIODS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}

_n = lambda: F.count(F.lit(1))


def price(provider: Column) -> Column:
    """The price per 1000 tokens, 0 for unknown providers; a constant of the plan, so no join."""
    out = F.lit(0.0)
    for name, value in PRICES.items():
        out = F.when(F.lower(provider) == name, F.lit(value)).otherwise(out)
    return out


def total_tokens() -> Column:
    return sum((F.coalesce(F.col(k), F.lit(0)) for k in TOKEN_KINDS), F.lit(0)).cast("long")


def with_totals(usage: DataFrame) -> DataFrame:
    """Add total tokens and their cost."""
    return usage.withColumn("total_tokens", total_tokens()).withColumn(
        "total_cost", F.col("total_tokens") / 1000 * price(F.col("provider"))
    )


def token_breakdown(usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = F.greatest(total_tokens(), F.lit(1))
    return usage.select(
        *keys,
        *[F.round(F.coalesce(F.col(k), F.lit(0)) / whole * 100, 2).alias(k.replace("tokens", "percent")) for k in TOKEN_KINDS],
    )


def compare_usage(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differences of two usage structs ``a`` and ``b`` of a row."""
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        *keys,
        (a["total_tokens"] - b["total_tokens"]).alias("token_difference"),
        F.round(a["total_cost"] - b["total_cost"], 6).alias("cost_difference"),
        (a["provider"] == b["provider"]).alias("same_provider"),
        (a["model"] == b["model"]).alias("same_model"),
    )


def token_statistics(usage: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summed token kinds, cost, and cost per token."""
    sums = with_totals(usage).groupBy(*by).agg(
        *[F.sum(k).alias(k) for k in TOKEN_KINDS],
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost").alias("_cost"),
    )
    return sums.select(
        *by,
        *TOKEN_KINDS,
        "total_tokens",
        F.round("_cost", 6).alias("total_cost"),
        F.round(t.share(F.col("_cost"), F.col("total_tokens")), 8).alias("average_token_cost"),
    )


def totals(usage: DataFrame) -> DataFrame:
    """Requests, tokens and mean duration, 0 when there are none."""
    return with_totals(usage).agg(
        _n().alias("total_chats"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.round(F.avg("duration_ms"), 2), F.lit(0.0)).alias("average_latency"),
    )


def model_statistics(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider", "model").agg(_n().alias("requests"))


def top_models(usage: DataFrame, limit: int = 10) -> DataFrame:
    return model_statistics(usage).orderBy(F.desc("requests"), "provider", "model").limit(limit)


def provider_statistics(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider").agg(_n().alias("requests"))


def conversation_statistics(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """Requests of the event table and tokens of the token table per conversation."""
    requests = events.groupBy("conversation_id").agg(_n().alias("requests"))
    sums = tokens.groupBy("conversation_id").agg(F.sum("total_tokens").alias("tokens"))
    return requests.join(sums, "conversation_id", "full_outer").select(
        "conversation_id",
        F.coalesce("requests", F.lit(0)).cast("long").alias("requests"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
    )


def user_statistics(usage: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return usage.groupBy("user_id").agg(_n().alias("activities"), distinct("conversation_id").alias("conversations"))


def daily_report(usage: DataFrame, day: str) -> DataFrame:
    """Requests and tokens of one day; the bounds are on the timestamp itself so that they reach the scan."""
    start = F.lit(day).cast("timestamp")
    of_day = usage.where((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("interval 1 day")))
    return with_totals(of_day).agg(
        F.lit(day).alias("date"),
        _n().alias("requests"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
    )


def daily_trend(usage: DataFrame, days: int = 30) -> DataFrame:
    per_day = usage.groupBy(F.to_date("created_at").alias("day")).agg(_n().alias("requests"))
    return per_day.orderBy(F.desc("day")).limit(days)


def rag_statistics(queries: DataFrame) -> DataFrame:
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return queries.agg(
        _n().alias("queries"),
        mean("retrieved_chunks", "average_chunks"),
        mean("similarity_score", "average_similarity"),
        mean("retrieval_time_ms", "average_latency"),
    )


def memory_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(
        _n().alias("requests"),
        F.round(F.avg("memories_used"), 6).alias("average_memories"),
        F.round(F.avg("memory_tokens"), 6).alias("average_tokens"),
    )


def top_users(usage: DataFrame, limit: int = 10) -> DataFrame:
    requests = usage.groupBy("user_id").agg(_n().alias("requests"))
    return requests.orderBy(F.desc("requests"), "user_id").limit(limit)


def performance_report(usage: DataFrame) -> DataFrame:
    d = "duration_ms"
    return usage.agg(
        F.min(d).alias("fastest"), F.max(d).alias("slowest"), F.round(F.avg(d), 6).alias("average")
    )


def cube(usage: DataFrame) -> DataFrame:
    """Partial sums per day, user, provider and model: what the dashboard is computed from."""
    return with_totals(usage).groupBy(F.to_date("created_at").alias("day"), "user_id", "provider", "model").agg(
        _n().alias("n"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("duration_ms").alias("ms"),
        F.min("duration_ms").alias("fastest"),
        F.max("duration_ms").alias("slowest"),
    )


def dashboard(usage: DataFrame, days: int = 30, users: int = 10) -> DataFrame:
    """All headline numbers as ``(metric, key, value)``.

    The table is scanned and shuffled once: every part reads the same exchange of partial sums.
    """
    c = cube(usage)
    whole = c.agg(
        F.sum("n").cast("double").alias("total_chats"),
        F.sum("tokens").cast("double").alias("total_tokens"),
        F.round(F.sum("ms") / F.sum("n"), 2).alias("average_latency"),
        F.min("fastest").alias("fastest"),
        F.max("slowest").alias("slowest"),
        F.count_distinct("user_id").cast("double").alias("users"),
    )
    names = whole.columns
    headline = whole.unpivot([], names, "metric", "value").select("metric", F.lit("all").alias("key"), "value")

    def part(metric: str, key: Column, top: int | None = None, newest: bool = False) -> DataFrame:
        grouped = c.groupBy(key.cast("string").alias("key")).agg(F.sum("n").cast("double").alias("value"))
        if top is not None:
            grouped = grouped.orderBy(F.desc("key") if newest else F.desc("value"), "key").limit(top)
        return grouped.select(F.lit(metric).alias("metric"), "key", "value")

    return (
        headline.unionByName(part("requests_by_model", F.col("model")))
        .unionByName(part("requests_by_provider", F.col("provider")))
        .unionByName(part("requests_by_day", F.col("day"), days, newest=True))
        .unionByName(part("requests_by_user", F.col("user_id"), users))
    )


def token_usage(usage: DataFrame) -> DataFrame:
    """Tokens and cost by provider and model with subtotals (null = all)."""
    return with_totals(usage).rollup("provider", "model").agg(
        F.grouping_id().cast("long").alias("level"),
        _n().alias("requests"),
        F.sum("total_tokens").alias("tokens"),
        F.round(F.sum("total_cost"), 6).alias("cost"),
    )


def usage_by(usage: DataFrame, keys: Sequence[Column]) -> DataFrame:
    return with_totals(usage).groupBy(*keys).agg(
        _n().alias("requests"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("total_cost"), 6).alias("cost")
    )


def between(df: DataFrame, start: str, end: str, ts: str = "created_at") -> DataFrame:
    """Rows from ``start`` up to, not including, ``end``."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def retain(df: DataFrame, as_of: str, days: int = 90, ts: str = "created_at") -> DataFrame:
    """Drop rows from more than ``days`` days before ``as_of``."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
    return df.where(F.col(ts) >= cutoff)


def success_rate(df: DataFrame, failed: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(~failed).alias("successes"),
        F.count_if(failed).alias("failures"),
        F.coalesce(F.round(F.count_if(~failed) / F.nullif(_n(), F.lit(0)) * 100, 2), F.lit(0.0)).alias("success_rate"),
    )


def session_ratios(usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages, tokens and users per session, 0 without sessions."""
    a = with_totals(usage).agg(
        _n().alias("messages"), F.sum("total_tokens").alias("tokens"), F.count_distinct("user_id").alias("users")
    )
    b = sessions.agg(_n().alias("sessions"))
    both = side_by_side(a, b)
    per = lambda c: F.round(t.share(F.col(c), F.col("sessions")), 2)
    return both.select(
        "messages",
        "tokens",
        "users",
        "sessions",
        per("messages").alias("messages_per_session"),
        per("tokens").alias("tokens_per_session"),
    )


def period_counters(usage: DataFrame, period: str = "daily") -> DataFrame:
    """Mergeable counters per period."""
    return with_totals(usage).groupBy(F.date_trunc(PERIODS[period], "created_at").alias("period")).agg(
        _n().alias("requests"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("duration_ms").alias("duration_sum"),
        F.count("duration_ms").alias("duration_count"),
    )


def calendar_rollup(usage: DataFrame) -> DataFrame:
    """Requests by year, month and day with all subtotals."""
    d = F.col("created_at")
    keyed = usage.select(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"))
    return keyed.rollup("year", "month", "day").agg(F.grouping_id().cast("long").alias("level"), _n().alias("requests"))


def merge_counters(*parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the counters of several periods; the mean duration is the true mean."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    s = lambda c: F.sum(c).alias(c)
    return every.groupBy(*by).agg(
        s("requests"),
        s("tokens"),
        F.round(F.sum("duration_sum") / F.sum("duration_count"), 4).alias("average_latency"),
    )
