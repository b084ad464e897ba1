"""Are the claims of an answer carried by its context?

Input rows hold ``answer`` (text) and ``context`` (array of texts). A context is what fitted into one prompt, so claims
and sentences are compared inside the row: no join, no shuffle, nothing grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t

# Support threshold, least words of a claim.
THRESHOLD = 0.75
MINIMUM_WORDS = 5


def claims(answer: Column) -> Column:
    """Distinct sentences of the lower-case answer with at least five words."""
    long = F.filter(t.sentences(t.collapse(answer)), lambda s: t.word_count(s) >= MINIMUM_WORDS)
    return F.array_distinct(long)


def context_sentences(context: Column) -> Column:
    return F.flatten(F.transform(context, lambda c: t.sentences(t.collapse(c))))


def verified(answer: Column, context: Column) -> Column:
    """``array<struct<claim,supported,score,evidence>>``: the first sentence with the best word overlap."""
    evidence = F.transform(
        context_sentences(context), lambda s: F.struct(s.alias("s"), F.array_distinct(t.words(s)).alias("w"))
    )
    none = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("evidence"))

    def check(claim: Column, sentences: Column) -> Column:
        def best(words: Column) -> Column:
            def better(acc: Column, e: Column) -> Column:
                share = F.size(F.array_intersect(words, e["w"])).cast("double") / F.greatest(F.size(words), F.lit(1))
                return t.let(
                    share,
                    lambda x: F.when(
                        x > acc["score"], F.struct(x.alias("score"), e["s"].alias("evidence"))
                    ).otherwise(acc),
                )

            return F.aggregate(sentences, none, better)

        return t.let(
            t.let(F.array_distinct(t.words(claim)), best),
            lambda b: F.struct(
                claim.alias("claim"),
                (b["score"] >= THRESHOLD).alias("supported"),
                F.round(b["score"], 4).alias("score"),
                b["evidence"].alias("evidence"),
            ),
        )

    return t.let(evidence, lambda es: F.transform(claims(answer), lambda c: check(c, es)))


def verify_claims(df: DataFrame, keys: Sequence[str], answer: str = "answer", context: str = "context") -> DataFrame:
    """One row per claim."""
    return df.select(*keys, F.posexplode(verified(F.col(answer), F.col(context))).alias("claim_index", "c")).select(
        *keys, F.col("claim_index").cast("long").alias("claim_index"), "c.*"
    )


def completeness(answer: Column, context: Column) -> Column:
    """Share of the distinct context words that occur in the answer."""
    return t.let(
        F.array_distinct(t.words(t.collapse(F.array_join(context, " ")))),
        lambda c: F.round(t.share(F.size(F.array_intersect(c, t.words(t.collapse(answer)))), F.size(c)), 4),
    )


def evaluate(df: DataFrame, keys: Sequence[str], answer: str = "answer", context: str = "context") -> DataFrame:
    """All scores per answer."""
    a, c = F.col(answer), F.col(context)
    rows = df.select(
        *keys,
        verified(a, c).alias("_v"),
        F.size(context_sentences(c)).alias("_n"),
        completeness(a, c).alias("completeness"),
    )
    v, total = F.col("_v"), F.size("_v")
    supported = F.size(F.filter(v, lambda x: x["supported"]))
    used = F.size(F.array_distinct(F.transform(F.filter(v, lambda x: x["supported"]), lambda x: x["evidence"])))
    # The scores have four places, so the sum is exact once rounded to four.
    score_sum = F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x["score"]), 4)
    return rows.select(
        *keys,
        F.round(t.share(supported, total), 4).alias("faithfulness"),
        F.round(t.share(score_sum, total), 4).alias("groundedness"),
        F.round(t.share(used, F.col("_n")), 4).alias("evidence_score"),
        supported.cast("long").alias("supported_claims"),
        (total - supported).cast("long").alias("unsupported_claims"),
        total.cast("long").alias("total_claims"),
        F.round(t.share(total - supported, total), 4).alias("unsupported_ratio"),
        "completeness",
    )


def statistics(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corpus totals with the best and the worst answer (ties: the smaller key)."""
    key = F.struct(*keys)
    s = F.col("faithfulness")
    return results.agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.round(F.avg(s), 4).alias("average_score"),
        F.round(F.avg("groundedness"), 4).alias("average_groundedness"),
        F.round(F.avg("evidence_score"), 4).alias("average_evidence_score"),
        F.sum("supported_claims").alias("supported_claims"),
        F.sum("unsupported_claims").alias("unsupported_claims"),
        *[F.min(F.struct((-s).alias("s"), key.alias("k")))["k"][k].alias(f"best_{k}") for k in keys],
        *[F.min(F.struct(s.alias("s"), key.alias("k")))["k"][k].alias(f"worst_{k}") for k in keys],
    )
