"""Traces and spans.

A span row holds ``trace_id, span_id, parent_span_id, name, span_type, status, start_time, end_time, attributes
(map), events (array of struct name, ts, attributes)``; ``end_time`` is null while it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.skew import side_by_side

# Span types and states.
SPAN_TYPES = (
    "llm", "rag", "memory", "retrieval", "embedding", "reranking", "tool", "database", "http", "custom",
)
STATES = ("unset", "ok", "error")


def duration_ms(start: str = "start_time", end: str = "end_time", as_of: Column | None = None) -> Column:
    """Milliseconds; a running span is measured up to ``as_of`` (null without)."""
    stop = F.col(end) if as_of is None else F.coalesce(F.col(end), as_of)
    return F.round((F.unix_micros(stop) - F.unix_micros(F.col(start))) / 1000, 3)


def search_spans(spans: DataFrame, keyword: str) -> DataFrame:
    """Name or attributes contain the keyword."""
    return spans.where(
        t.contains_ci(F.col("name"), keyword) | t.contains_ci(F.to_json("attributes"), keyword)
    )


def filter_spans(spans: DataFrame, status: str | None = None, span_type: str | None = None) -> DataFrame:
    if status is not None:
        spans = spans.where(F.col("status") == status)
    return spans if span_type is None else spans.where(F.col("span_type") == span_type)


def statistics(spans: DataFrame) -> DataFrame:
    return spans.agg(
        F.count_distinct("trace_id").alias("trace_count"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(F.col("end_time").isNull()).alias("active_spans"),
        F.count_if(F.col("end_time").isNotNull()).alias("completed_spans"),
        F.count_if(F.col("status") == "error").alias("error_spans"),
    )


def trace_summaries(spans: DataFrame, as_of: Column | None = None) -> DataFrame:
    stop = F.max(F.col("end_time") if as_of is None else F.coalesce("end_time", as_of))
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(F.col("end_time").isNotNull()).alias("completed_spans"),
        F.count_if(F.col("status") == "error").alias("error_spans"),
        F.round((F.unix_micros(stop) - F.unix_micros(F.min("start_time"))) / 1000, 3).alias("duration_ms"),
        F.round(F.avg(duration_ms(as_of=as_of)), 6).alias("average_span_duration_ms"),
    )


def mean_durations(spans: DataFrame, as_of: Column | None = None) -> DataFrame:
    traces = trace_summaries(spans, as_of).agg(F.round(F.avg("duration_ms"), 3).alias("average_trace_duration"))
    finished = spans.where("end_time is not null").agg(F.round(F.avg(duration_ms()), 3).alias("average_span_duration"))
    return side_by_side(traces, finished)


def counts_with_zeros(spans: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Spans per type or state, every known value listed."""
    known = spans.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = spans.groupBy(column).agg(F.count(F.lit(1)).alias("spans"))
    return known.join(counts, column, "left").withColumn("spans", F.coalesce("spans", F.lit(0)).cast("long"))


def exceptions(spans: DataFrame) -> DataFrame:
    """Recorded exceptions by type and message."""
    e = F.col("e")
    return (
        spans.select("span_id", F.explode("events").alias("e"))
        .where(e["name"] == "exception")
        .groupBy(e["attributes"]["type"].alias("exception_type"), e["attributes"]["message"].alias("message"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def attribute_statistics(spans: DataFrame, span_type: str, attribute: str) -> DataFrame:
    """Spans of one type by one of their attributes."""
    return (
        spans.where(F.col("span_type") == span_type)
        .groupBy(F.col("attributes")[attribute].alias(attribute))
        .agg(F.count(F.lit(1)).alias("spans"), F.round(F.avg(duration_ms()), 3).alias("average_ms"))
    )
