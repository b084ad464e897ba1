"""Ranking, classification, regression and overlap metrics.

Ranking input is ``runs(query_id, rank, doc_id)`` (optionally with ``system``) and ``qrels(query_id, doc_id, grade)``;
``judge`` joins them once and every metric is an aggregate of the judged runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorespan.functions import text as t
from lorespan.operators.skew import exact_quantiles, join_on


def judge(runs: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("query_id",), doc: str = "doc_id") -> DataFrame:
    """Add ``grade`` (0 where not judged)."""
    on = ["query_id", doc]
    return runs.join(qrels.select(*on, "grade"), on, "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def relevant_counts(qrels: DataFrame) -> DataFrame:
    return qrels.where("grade > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))


_hit = (lambda: (F.col("grade") > 0).cast("double"))


def precision_at_k(judged: DataFrame, k: int = 5, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Hits over the number actually retrieved among the first k."""
    return judged.where(F.col("rank") <= k).groupBy(*keys).agg(F.round(F.avg(_hit()), 4).alias(f"precision_at_{k}"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def ranking_metrics(
    judged: DataFrame, qrels: DataFrame, k: int = 5, keys: Sequence[str] = ("query_id",), doc: str = "doc_id"
) -> DataFrame:
    """Per query (and system): precision, recall, F1, hit rate, reciprocal rank, DCG, nDCG and average precision.

    ``qrels`` are judgements, or already the number ``relevant`` per query. The ideal order of nDCG is taken from the grades of the retrieved list. Result lists are bounded by the retrieval
    depth, so the windows per query are small.
    """
    keys = list(keys)
    in_k = F.col("rank") <= k
    by_rank = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    by_grade = Window.partitionBy(*keys).orderBy(F.desc("grade"), "rank")
    rows = (
        judged.withColumn("_hit", _hit())
        .withColumn("_hits", F.sum("_hit").over(by_rank))
        .withColumn("_ideal", F.row_number().over(by_grade))
    )
    gain = lambda pos: F.col("grade") / F.log2(pos + 1)
    agg = rows.groupBy(*keys).agg(
        F.sum(F.when(in_k, F.col("_hit")).otherwise(0.0)).alias("_h"),
        F.sum(in_k.cast("double")).alias("_n"),
        F.min(F.when(F.col("_hit") > 0, F.col("rank"))).alias("_first"),
        F.sum(F.when(in_k, gain(F.col("rank"))).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(F.col("_ideal") <= k, gain(F.col("_ideal"))).otherwise(0.0)).alias("_idcg"),
        F.sum(F.when(F.col("_hit") > 0, F.col("_hits") / F.col("rank")).otherwise(0.0)).alias("_ap"),
    )
    counts = qrels if "relevant" in qrels.columns else relevant_counts(qrels)
    full = agg.join(counts.select("query_id", "relevant"), "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    precision, recall = t.share(F.col("_h"), F.col("_n")), t.share(F.col("_h"), F.col("relevant"))
    return full.select(
        *keys,
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1(precision, recall), 4).alias("f1"),
        F.when(F.col("_h") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 4).alias("reciprocal_rank"),
        F.round("_dcg", 4).alias("dcg"),
        F.round(t.share(F.col("_dcg"), F.col("_idcg")), 4).alias("ndcg"),
        F.round(t.share(F.col("_ap"), F.col("relevant")), 4).alias("average_precision"),
    )


def mean_metrics(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over queries: MRR is the mean reciprocal rank, MAP the mean average precision."""
    names = {"precision": "precision", "recall": "recall", "f1": "f1", "hit_rate": "hit_rate", "ndcg": "ndcg"}
    names |= {"reciprocal_rank": "mrr", "average_precision": "map"}
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(a), 4).alias(b) for a, b in names.items()]
    )


# Classification and regression -----------------------------------------------------------------------------------


def classification(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of a binary prediction with accuracy, precision, recall, specificity and F1."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = t.share(tp, tp + fp), t.share(tp, tp + fn)
    return counts.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        F.round(t.share(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(t.share(tn, tn + fp), 4).alias("specificity"),
        F.round(f1(precision, recall), 4).alias("f1"),
    )


def regression_errors(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(truth).cast("double") - F.col(predicted)
    mse = F.avg(d * d)
    return df.groupBy(*by).agg(
        F.round(mse, 4).alias("mse"), F.round(F.sqrt(mse), 4).alias("rmse"), F.round(F.avg(F.abs(d)), 4).alias("mae")
    )


# Text overlap ----------------------------------------------------------------------------------------------------


def exact_match(a: Column, b: Column) -> Column:
    return F.when(t.normalize(a) == t.normalize(b), 1.0).otherwise(0.0)


def overlap_score(a: Column, b: Column) -> Column:
    """Shared distinct words over the distinct words of the first text."""
    return t.let(
        F.array_distinct(t.tokens(a)), lambda x: t.share(F.size(F.array_intersect(x, t.tokens(b))), F.size(x))
    )


def jaccard_similarity(a: Column, b: Column) -> Column:
    both = F.struct(t.tokens(a).alias("a"), t.tokens(b).alias("b"))
    return t.let(
        both,
        lambda s: t.share(F.size(F.array_intersect(s["a"], s["b"])), F.size(F.array_union(s["a"], s["b"]))),
    )


def _ngrams(words: Column, n: int) -> Column:
    """Sorted n-grams of a word array."""
    return t.let(
        words,
        lambda w: F.sort_array(
            F.when(
                F.size(w) >= n,
                F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")),
            ).otherwise(F.array().cast("array<string>"))
        ),
    )


def _numbered(sorted_grams: Column) -> Column:
    """Mark each copy of a gram with its occurrence number, which turns a bag into a set."""
    copies = lambda r: F.transform(
        F.sequence(F.lit(1).cast("long"), r["copies"]), lambda i: F.concat(r["value"], F.lit("\n"), i.cast("string"))
    )
    return F.flatten(F.transform(t.runs(sorted_grams), copies))


def ngram_overlap(df: DataFrame, reference: str, candidate: str, sizes: Sequence[int]) -> DataFrame:
    """Add per n: clipped matches and the number of n-grams on either side, all inside the row.

    Numbered copies make the clipped match count a set intersection, so no n-gram leaves its row.
    """
    out = df.withColumn("_rw", t.tokens(F.col(reference))).withColumn("_cw", t.tokens(F.col(candidate)))
    for n in sizes:
        r, c = _numbered(_ngrams(F.col("_rw"), n)), _numbered(_ngrams(F.col("_cw"), n))
        out = (
            out.withColumn(f"match_{n}", F.size(F.array_intersect(c, r)).cast("long"))
            .withColumn(f"candidate_{n}", F.greatest(F.size("_cw") - (n - 1), F.lit(0)).cast("long"))
            .withColumn(f"reference_{n}", F.greatest(F.size("_rw") - (n - 1), F.lit(0)).cast("long"))
        )
    return out.drop("_rw", "_cw")


def bleu(df: DataFrame, reference: str, candidate: str, by: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU per group: clipped 1- to 4-gram precision with the brevity penalty, on normalised words."""
    sizes = (1, 2, 3, 4)
    rows = ngram_overlap(df, reference, candidate, sizes)
    totals = rows.groupBy(*by).agg(
        *[F.sum(f"{side}_{n}").alias(f"{side}_{n}") for side in ("match", "candidate") for n in sizes],
        F.sum("reference_1").alias("reference_1"),
    )
    logs = sum((F.log(F.col(f"match_{n}") / F.col(f"candidate_{n}")) for n in sizes), F.lit(0.0)) / len(sizes)
    brevity = F.least(F.lit(0.0), 1 - F.col("reference_1") / F.col("candidate_1"))
    zero = F.least(*[F.col(f"match_{n}") for n in sizes]) == 0
    return totals.select(*by, F.when(zero, 0.0).otherwise(F.round(F.exp(logs + brevity), 4)).alias("bleu"))


def rouge(df: DataFrame, reference: str, candidate: str, keys: Sequence[str]) -> DataFrame:
    """ROUGE-1 and ROUGE-2 F-measure per pair."""
    rows = ngram_overlap(df, reference, candidate, (1, 2))

    def measure(n: int) -> Column:
        p = t.share(F.col(f"match_{n}"), F.col(f"candidate_{n}"))
        r = t.share(F.col(f"match_{n}"), F.col(f"reference_{n}"))
        return F.round(f1(p, r), 4)

    return rows.select(*keys, measure(1).alias("rouge1"), measure(2).alias("rouge2"))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, as a fold over ``a``.

    The fold keeps, for every length, the smallest place in ``b`` at which a common subsequence of that length can end.
    An element's places in ``b`` are put in from the last to the first, so that each extends only what stood before it.
    """

    def put(ends: Column, place: Column) -> Column:
        before = F.size(F.filter(ends, lambda x: x < place))
        return F.concat(F.slice(ends, 1, before), F.array(place), F.slice(ends, before + 2, F.greatest(F.size(ends) - before - 1, F.lit(0))))

    def step(ends: Column, x: Column) -> Column:
        places = F.array_compact(F.transform(b, lambda y, i: F.when(x == y, i)))
        return F.aggregate(F.reverse(places), ends, put)

    return F.size(F.aggregate(a, F.array().cast("array<int>"), step))


def rouge_l(df: DataFrame, reference: str, candidate: str, keys: Sequence[str]) -> DataFrame:
    """ROUGE-L per pair: F-measure of the longest common subsequence of words. No words on a side: 0; a missing text: null."""
    rows = df.withColumn("_rw", t.tokens(F.col(reference))).withColumn("_cw", t.tokens(F.col(candidate)))
    rows = rows.withColumn("_n", longest_common(F.col("_cw"), F.col("_rw")).cast("long"))
    p, r = (t.share(F.col("_n"), F.size(c).cast("long")) for c in ("_cw", "_rw"))
    return rows.select(*keys, F.col("_n").alias("common"), F.round(f1(p, r), 4).alias("rougeL"))


# Metric history --------------------------------------------------------------------------------------------------


def metric_statistics(history: DataFrame, by: Sequence[str] = ("metric",), value: str = "score") -> DataFrame:
    """Count, mean, extremes, exact median and population deviation of the recorded scores."""
    by = list(by)
    x = F.col(value).cast("double")
    sums = history.groupBy(*by).agg(
        F.count(F.lit(1)).alias("metrics"),
        F.round(F.avg(x), 4).alias("average"),
        F.round(F.min(x), 4).alias("minimum"),
        F.round(F.max(x), 4).alias("maximum"),
        F.round(F.stddev_pop(x), 4).alias("std"),
    )
    medians = exact_quantiles(history, by, value, [0.5], ["median"])
    return join_on(sums, medians, by, "left").withColumn("median", F.round("median", 4))


def find_metric(history: DataFrame, name: str) -> DataFrame:
    return history.where(F.col("metric") == name)
