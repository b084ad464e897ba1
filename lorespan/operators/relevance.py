"""Relevance of retrieved documents: (query, document) pairs in, scores per pair, query and retriever out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.benchmark import _mean as exact_mean
from lorespan.operators.rankeval import overlap_score
from lorespan.operators.skew import first_rows, position

# Weights of the two parts, threshold, bounds of the distribution.
KEYWORD_WEIGHT = 0.4
SEMANTIC_WEIGHT = 0.6
THRESHOLD = 0.75
HIGH = 0.8
MEDIUM = 0.5


def score_pairs(
    pairs: DataFrame, query_text: str = "query_text", text: str = "text", semantic: Column | None = None
) -> DataFrame:
    """Add keyword, semantic and combined score. Without a semantic column that part counts 0."""
    keyword = F.round(overlap_score(F.col(query_text), F.col(text)), 4)
    scored = pairs.withColumn("keyword_score", keyword).withColumn(
        "semantic_score", F.lit(0.0) if semantic is None else F.round(semantic, 4)
    )
    combined = KEYWORD_WEIGHT * F.col("keyword_score") + SEMANTIC_WEIGHT * F.col("semantic_score")
    return scored.withColumn("relevance", F.round(combined, 4)).withColumn(
        "relevant", F.col("relevance") >= THRESHOLD
    )


def rank_documents(scored: DataFrame, keys: Sequence[str], doc: str, k: int | None = None) -> DataFrame:
    """Rank per query by combined score; ties keep the smaller document id."""
    order = [F.desc("relevance"), F.col(doc)]
    scored = scored.drop("rank")
    if k is not None:
        return first_rows(scored, keys, order, k, "rank")
    # All ranks: buckets of the score, so that a query with very many documents is spread over its scores.
    return position(scored, keys, order, F.floor(-F.col("relevance") * 10_000), "rank")


def split_relevant(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    return scored.where("relevant"), scored.where(~F.col("relevant"))


def evaluate(scored: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Per query (and retriever): mean scores, documents, relevant documents."""
    return scored.groupBy(*keys).agg(
        exact_mean("relevance", 4).alias("score"),
        exact_mean("keyword_score", 4).alias("keyword_score"),
        exact_mean("semantic_score", 4).alias("semantic_score"),
        F.count(F.lit(1)).alias("document_count"),
        F.count_if("relevant").alias("relevant_documents"),
    )


def query_summary(pairs: DataFrame, keys: Sequence[str] = ("query_id",), query_text="query_text", text="text") -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.max(F.size(t.tokens(F.col(query_text)))).cast("long").alias("query_tokens"),
        F.count(F.lit(1)).alias("documents"),
        F.round(F.avg(F.size(t.tokens(F.col(text)))), 2).alias("average_document_tokens"),
    )


def distribution(results: DataFrame) -> DataFrame:
    s = F.col("score")
    return results.agg(
        F.count_if(s >= HIGH).alias("high"),
        F.count_if((s >= MEDIUM) & (s < HIGH)).alias("medium"),
        F.count_if(s < MEDIUM).alias("low"),
    )


def statistics(results: DataFrame, by: Sequence[str] = (), key: str = "query_id") -> DataFrame:
    """Mean and extremes with the best and the worst query (ties: the smaller id)."""
    s = F.col("score")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluations"),
        exact_mean("score", 4).alias("average_score"),
        F.min(s).alias("minimum_score"),
        F.max(s).alias("maximum_score"),
        F.min(F.struct((-s).alias("s"), F.col(key).alias("k")))["k"].alias("best_query"),
        F.min(F.struct(s.alias("s"), F.col(key).alias("k")))["k"].alias("worst_query"),
    )
