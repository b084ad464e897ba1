"""Comparison of systems: score rows ``(system, query_id, scores, latency_ms)`` in, reports out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lorespan.functions import text as t

SUCCESS = 0.75
PARTS = ("retrieval_score", "relevance_score", "faithfulness_score", "hallucination_score")


def _mean(column: str, places: int):
    """Mean over decimals: exact, whatever the order in which tasks deliver their parts."""
    return F.round(F.avg(F.col(column).cast("decimal(18,6)")), places).cast("double")


def validate_dataset(queries: DataFrame, query: str = "query") -> DataFrame:
    """One row: is there a query, and is none of them empty."""
    filled = F.coalesce(F.col(query) != "", F.lit(False))
    return queries.agg(F.coalesce(F.bool_and(filled), F.lit(False)).alias("valid"), F.count(F.lit(1)).alias("queries"))


def join_scores(tables: Sequence[DataFrame], keys: Sequence[str] = ("system", "query_id")) -> DataFrame:
    """Put the score tables of the evaluators side by side."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, list(keys), "full_outer")
    return out


def overall(scores: DataFrame) -> DataFrame:
    """Add ``overall_score``: the mean of the parts that are present (the hallucination score as it is: 1 is clean)."""
    parts = [F.col(p) for p in PARTS if p in scores.columns]
    present = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return scores.withColumn("overall_score", F.round(t.share(total, present), 4))


def statistics(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = F.col("overall_score")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_queries"),
        _mean("overall_score", 4).alias("average_score"),
        _mean("latency_ms", 2).alias("average_latency"),
        F.min(s).alias("minimum_score"),
        F.max(s).alias("maximum_score"),
        F.round(F.avg((s >= SUCCESS).cast("double")), 4).alias("success_rate"),
    )


def runtime_statistics(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    seconds = F.sum(F.col("latency_ms").cast("decimal(28,6)")).cast("double") / 1000
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(seconds, 3).alias("total_runtime_seconds"),
        F.when(seconds > 0, F.round(F.count(F.lit(1)) / seconds, 2)).otherwise(0.0).alias("throughput_qps"),
    )


def compare(results: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Statistics for every combination of the dimensions and their totals (null = all)."""
    return (
        results.cube(*dimensions)
        .agg(
            F.grouping_id().cast("long").alias("level"),
            F.count(F.lit(1)).alias("total_queries"),
            _mean("overall_score", 4).alias("average_score"),
            _mean("latency_ms", 2).alias("average_latency"),
        )
    )


def ranking(per_system: DataFrame, system: str = "system") -> DataFrame:
    """Systems by mean score; one row per system."""
    w = Window.orderBy(F.desc("average_score"))
    return per_system.withColumn("position", F.rank().over(w).cast("long"))


def report(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary row and per-query rows."""
    summary = results.agg(
        F.count(F.lit(1)).alias("queries"),
        _mean("overall_score", 4).alias("average_score"),
        _mean("latency_ms", 2).alias("average_latency"),
        F.max("overall_score").alias("best_score"),
        F.min("overall_score").alias("worst_score"),
    )
    parts = [p for p in PARTS if p in results.columns]
    return summary, results.select("system", "query_id", *parts, "latency_ms", "overall_score")


def history(runs: DataFrame, run: str = "run_id", system: str = "system") -> DataFrame:
    """Mean score per run and system with the change since the run before (one row per run and system)."""
    means = runs.groupBy(run, system).agg(_mean("overall_score", 4).alias("average_score"))
    before = F.lag("average_score").over(Window.partitionBy(system).orderBy(run))
    return means.withColumn("change", F.round(F.col("average_score") - before, 4))


def append_run(results: DataFrame, path: str, run_id: str) -> None:
    """Store a run next to the earlier ones."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs, with their ``run_id``."""
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
