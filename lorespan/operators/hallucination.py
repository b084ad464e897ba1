"""What an answer says that its context does not: claims, numbers, dates, entities, contradictions.

Input rows hold ``answer`` and ``context`` (array of texts); everything is compared inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t

# Patterns and negation words.
NUMBER = "(?U)(\\b\\d+(?:\\.\\d+)?\\b)"
DATE = (
    "(\\b\\d{4}-\\d{2}-\\d{2}\\b|\\b\\d{1,2} (?:january|february|march|april|may|june|july|august|september|october|"
    "november|december) \\d{4}\\b)"
)
ENTITY = "(\\p{Lu}[\\p{L}\\p{N}_]+(?: \\p{Lu}[\\p{L}\\p{N}_]+)+)"
NEGATIONS = ("not", "never", "none", "no", "without", "cannot")


def claims(answer: Column) -> Column:
    return t.sentences(t.collapse(answer))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER)))


def dates(c: Column) -> Column:
    """ISO dates and ``day month year``, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(DATE)))


def entities(c: Column) -> Column:
    """Runs of two or more capitalised words, lower case; use a column of your own where a model is at hand."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(ENTITY)), lambda e: F.lower(e)))


def detect(
    df: DataFrame,
    keys: Sequence[str],
    answer: str = "answer",
    context: str = "context",
    answer_entities: Column | None = None,
    context_entities: Column | None = None,
) -> DataFrame:
    """Per answer: the claims and everything in them that the context does not hold, as arrays."""
    a = F.col(answer)
    joined = df.withColumn("_raw", F.array_join(context, " "))
    base = joined.select(
        "*",
        t.collapse(F.col("_raw")).alias("_ctx"),
        claims(a).alias("claims"),
    )
    negative = lambda text: F.arrays_overlap(
        t.words(text), F.array(*[F.lit(n) for n in NEGATIONS])
    )
    ctx = F.col("_ctx")
    mine = answer_entities if answer_entities is not None else entities(a)
    theirs = context_entities if context_entities is not None else entities(F.col("_raw"))
    found = base.select(
        *keys,
        "claims",
        F.filter("claims", lambda x: ~F.contains(ctx, x)).alias("unsupported"),
        F.filter("claims", lambda x: F.contains(ctx, x)).alias("_present"),
        negative(ctx).alias("_ctx_negative"),
        numbers(a).alias("answer_numbers"),
        F.sort_array(F.array_except(numbers(a), numbers(ctx))).alias("new_numbers"),
        dates(a).alias("answer_dates"),
        F.sort_array(F.array_except(dates(a), dates(ctx))).alias("new_dates"),
        mine.alias("answer_entities"),
        F.sort_array(F.array_except(mine, theirs)).alias("new_entities"),
    )
    contradictions = F.filter("_present", lambda x: negative(x) != F.col("_ctx_negative"))
    return found.withColumn("contradictions", contradictions).drop("_present", "_ctx_negative")


def evaluate(detected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, coverages, hallucination score, factual consistency and confidence per answer."""
    n = lambda c: F.size(c).cast("long")
    total = F.greatest(F.size("claims"), F.lit(1))
    errors = n("unsupported") + n("new_entities") + n("new_numbers") + n("new_dates") + n("contradictions")
    cover = lambda new, all_: F.round(t.share(F.size(all_) - F.size(new), F.size(all_), 1.0), 4)
    first = detected.select(
        *keys,
        n("claims").alias("claims"),
        n("unsupported").alias("unsupported_claims"),
        n("new_entities").alias("entity_errors"),
        n("new_numbers").alias("numeric_errors"),
        n("new_dates").alias("date_errors"),
        n("contradictions").alias("contradictions"),
        cover("new_entities", "answer_entities").alias("entity_coverage"),
        cover("new_numbers", "answer_numbers").alias("numeric_coverage"),
        cover("new_dates", "answer_dates").alias("date_coverage"),
        F.round(F.greatest(F.lit(0.0), 1 - errors / total), 4).alias("score"),
        F.round(t.share(F.size("claims") - F.size("unsupported"), F.size("claims"), 1.0), 4).alias(
            "evidence_coverage"
        ),
    )
    consistency = (F.col("entity_coverage") + F.col("numeric_coverage") + F.col("date_coverage")) / 3
    second = first.withColumn("factual_consistency", F.round(consistency, 4))
    confidence = (F.col("score") + F.col("factual_consistency") + F.col("evidence_coverage")) / 3
    return second.withColumn("confidence", F.round(confidence, 4))


def _extremes(score: Column, keys: Sequence[str]) -> list[Column]:
    """Keys of the best and the worst row (ties: the smaller key)."""
    key = F.struct(*keys)
    return [
        *[F.min(F.struct((-score).alias("s"), key.alias("k")))["k"][k].alias(f"best_{k}") for k in keys],
        *[F.min(F.struct(score.alias("s"), key.alias("k")))["k"][k].alias(f"worst_{k}") for k in keys],
    ]


def statistics(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals of evaluated answers; with ``keys``, those of the answer with the best and the worst score."""
    total = lambda c: F.sum(c).alias(c)
    return results.agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.round(F.avg("score"), 4).alias("average_score"),
        *[total(c) for c in ("entity_errors", "numeric_errors", "date_errors", "unsupported_claims", "contradictions")],
        F.min("score").alias("minimum_score"),
        F.max("score").alias("maximum_score"),
        *(_extremes(F.col("score"), keys) if keys else []),
    )
