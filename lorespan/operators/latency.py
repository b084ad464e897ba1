"""Latency of pipelines: one row per request with one column per stage (milliseconds)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.benchmark import _mean as exact_mean
from lorespan.operators.skew import exact_quantiles, join_on

# The stages, the latency flags and the grade bounds.
STAGES = ("preprocessing", "chunking", "embedding", "retrieval", "vectorstore", "reranking", "generation")
HIGH_MS = 1000.0
WARNING_MS = 500.0
GRADES = ((100, "A+"), (250, "A"), (500, "B"), (1000, "C"), (2000, "D"))


def _stage(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def total(stages: Sequence[str] = STAGES) -> Column:
    return sum((_stage(s) for s in stages[1:]), _stage(stages[0]))


def per_second(items: Column, ms: Column) -> Column:
    return F.when(ms <= 0, F.lit(0.0)).otherwise(F.round(items / (ms / 1000), 2))


def grade(ms: Column) -> Column:
    out = F.lit("F")
    for bound, name in reversed(GRADES):
        out = F.when(ms <= bound, name).otherwise(out)
    return out


def evaluate(
    df: DataFrame,
    keys: Sequence[str],
    stages: Sequence[str] = STAGES,
    queries: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """Total, throughput, stage shares, slowest and fastest stage, grade and flags of every request.

    Ties between stages go to the earlier stage.
    """
    queries = F.lit(1) if queries is None else queries
    tokens = F.lit(0) if tokens is None else tokens
    rows = df.withColumn("_total", total(stages))
    ms = F.col("_total")
    share_of = F.greatest(ms, F.lit(1e-9))
    ranked = lambda sign: F.array_min(
        F.array(*[F.struct((_stage(s) * sign).alias("v"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(stages)])
    )["s"]
    return rows.select(
        *keys,
        F.round(ms, 4).alias("total_latency"),
        per_second(queries, ms).alias("queries_per_second"),
        per_second(tokens, ms).alias("tokens_per_second"),
        *[F.round(_stage(s) / share_of * 100, 2).alias(f"{s}_percent") for s in stages],
        ranked(-1.0).alias("slowest_stage"),
        ranked(1.0).alias("fastest_stage"),
        grade(ms).alias("grade"),
        (ms >= HIGH_MS).alias("high_latency"),
        (ms >= WARNING_MS).alias("warning_latency"),
    )


def stage_statistics(samples: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    """Recorded samples ``(stage, ms)``: count, mean, extremes and exact quantiles per stage."""
    sums = samples.groupBy(stage).agg(
        F.count(ms).alias("samples"),
        F.round(F.avg(ms), 3).alias("average"),
        F.min(ms).alias("minimum"),
        F.max(ms).alias("maximum"),
    )
    q = exact_quantiles(samples, [stage], ms, [0.5, 0.95, 0.99], ["p50", "p95", "p99"])
    return join_on(sums, q.select(stage, *[F.round(x, 4).alias(x) for x in ("p50", "p95", "p99")]), [stage], "left")


def unpivot_stages(df: DataFrame, keys: Sequence[str], stages: Sequence[str] = STAGES) -> DataFrame:
    return df.unpivot(list(keys), list(stages), "stage", "ms").where(F.col("ms").isNotNull())


def _extremes(score: Column, keys: Sequence[str]) -> list[Column]:
    """Keys of the fastest and the slowest row (ties: the smaller key)."""
    key = F.struct(*keys)
    return [
        *[F.min(F.struct(score.alias("s"), key.alias("k")))["k"][k].alias(f"best_{k}") for k in keys],
        *[F.min(F.struct((-score).alias("s"), key.alias("k")))["k"][k].alias(f"worst_{k}") for k in keys],
    ]


def statistics(results: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Mean, extremes and rates of evaluated requests; with ``keys``, those of the fastest and the slowest one."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluations"),
        exact_mean("total_latency", 3).alias("average_latency"),
        F.min("total_latency").alias("minimum_latency"),
        F.max("total_latency").alias("maximum_latency"),
        exact_mean("queries_per_second", 2).alias("average_qps"),
        exact_mean("tokens_per_second", 2).alias("average_tokens_per_second"),
        F.count_if("high_latency").alias("high"),
        F.count_if("warning_latency").alias("warning"),
        *(_extremes(F.col("total_latency"), keys) if keys else []),
    )
