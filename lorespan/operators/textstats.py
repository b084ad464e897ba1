"""Text and token statistics of documents, chunks and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.skew import exact_quantiles, side_by_side


def statistics(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Characters, words, lines, empty lines and paragraphs of each text."""
    x = F.col(text)
    return df.select(
        key,
        F.length(x).cast("long").alias("characters"),
        t.word_count(x).alias("words"),
        t.line_count(x).alias("lines"),
        F.size(F.filter(t.lines(x), lambda l: t.strip(l) == "")).cast("long").alias("empty_lines"),
        F.size(F.split(x, t.PARAGRAPH_GAP)).cast("long").alias("paragraphs"),
        t.sentence_count(x).alias("sentences"),
    )


def token_estimates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    x = F.col(text)
    methods = ("chars4", "chars4_or_zero", "chars4_floor", "words", "words13")
    return df.select(key, *[t.token_estimate(x, m).alias(m) for m in methods])


def token_statistics(df: DataFrame, text: str = "text", method: str = "words13") -> DataFrame:
    """Corpus totals of the token estimate with the exact median."""
    counts = df.select(t.token_estimate(F.col(text), method).alias("n"))
    median = exact_quantiles(counts, [], "n", [0.5], ["median"])
    totals = counts.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"),
        F.min("n").alias("minimum"),
        F.max("n").alias("maximum"),
        F.round(F.avg("n"), 2).alias("average"),
    )
    return side_by_side(totals, median).withColumn("median", F.round("median", 2))


def fits_context(df: DataFrame, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    used = t.token_estimate(F.col(text), "words13")
    return df.select(
        key,
        used.alias("used"),
        F.greatest(F.lit(0).cast("long"), F.lit(limit) - used).alias("remaining"),
        (used <= limit).alias("fits"),
    )


def truncate_words(c: Column, limit: int = 512) -> Column:
    return F.array_join(F.slice(t.words(c), 1, limit), " ")


def truncate_characters(c: Column, limit: int = 12_000) -> Column:
    return F.substring(c, 1, limit)


def truncate_tokens(c: Column, tokens: int = 6_000) -> Column:
    """Four characters per token."""
    return F.substring(c, 1, 4 * tokens)


def prompt_statistics(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    x = F.col(text)
    return df.select(
        *keys,
        F.length(x).cast("long").alias("characters"),
        t.token_estimate(x, "chars4_floor").alias("tokens"),
        t.line_count(x).alias("lines"),
    )


# States of documents and chunks, and those that count as processed.
DOCUMENT_STATES = ("new", "processed", "indexed", "embedded", "failed", "deleted")
CHUNK_STATES = ("new", "embedded", "indexed", "retrieved", "failed", "deleted")
PROCESSED_STATES = ("processed", "indexed", "embedded")


def is_processed(status: Column) -> Column:
    return status.isin(*PROCESSED_STATES)


def status_funnel(df: DataFrame, by: str = "source", states: tuple[str, ...] = DOCUMENT_STATES) -> DataFrame:
    """Rows per state, one column each."""
    counts = df.groupBy(by).pivot("status", list(states)).agg(F.count(F.lit(1)))
    return counts.select(by, *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in states])


def add_tag(tags: Column, tag: str) -> Column:
    return F.array_union(tags, F.array(F.lit(tag)))


def remove_tag(tags: Column, tag: str) -> Column:
    return F.array_remove(tags, tag)


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("documents"))


def mean_chunk_size(documents: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Characters of a document divided by its number of chunks, 0 without chunks."""
    n = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))
    return (
        documents.select(key, F.length(text).cast("long").alias("characters"))
        .join(n, key, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(0)).cast("long"))
        .withColumn("mean_chunk_size", F.round(t.share(F.col("characters"), F.col("chunks")), 2))
    )


def compare_pairs(df: DataFrame, left: str, right: str, flags: dict[str, tuple[str, str]]) -> DataFrame:
    """Compare two texts of a row: equality flags, absolute length and word differences, checksum similarity."""
    a, b = F.col(left), F.col(right)
    return df.select(
        "*",
        *[(F.col(x) == F.col(y)).alias(name) for name, (x, y) in flags.items()],
        F.abs(F.length(a) - F.length(b)).cast("long").alias("character_difference"),
        F.abs(t.word_count(a) - t.word_count(b)).alias("word_difference"),
        F.when(F.sha2(a, 256) == F.sha2(b, 256), 1.0).otherwise(0.0).alias("similarity"),
    )
