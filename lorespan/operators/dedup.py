"""Duplicate lines, texts, rows and hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.skew import keep_first


def find_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", minimum: int = 2) -> DataFrame:
    """``(key, line, occurrences)`` of stripped, lower-case lines that occur at least ``minimum`` times in a document.

    Counting is local to the document: equal lines are neighbours once sorted.
    """
    keys = F.filter(F.transform(t.lines(F.col(text)), lambda x: F.lower(t.strip(x))), lambda k: k != "")
    return (
        df.select(key, F.explode(t.runs(F.sort_array(keys))).alias("r"))
        .select(key, F.col("r.value").alias("line"), F.col("r.copies").alias("occurrences"))
        .where(F.col("occurrences") >= minimum)
    )


def keep_first_text(df: DataFrame, order: Sequence[str], text: str = "text", within: Sequence[str] = ()) -> DataFrame:
    """The first row of each text. Each map task already drops all but its first row of a text."""
    digest = df.withColumn("_digest", F.sha2(text, 256))
    return keep_first(digest, [*within, "_digest"], order).drop("_digest")


def flag_known(df: DataFrame, known: DataFrame, key: str = "checksum", name: str = "is_duplicate") -> DataFrame:
    """Mark rows whose checksum is in ``known``. Known checksums are made distinct first, so no copy multiplies."""
    seen = known.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(seen, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def only_new(df: DataFrame, known: DataFrame, key: str = "checksum") -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def only_known(df: DataFrame, known: DataFrame, key: str = "checksum") -> DataFrame:
    return df.join(known.select(key), key, "left_semi")


def equal_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Checksums shared by several rows with their number and first key.

    Similarity 1.0 holds inside a group and 0.0 between groups; the pairs themselves are never produced.
    """
    return (
        df.groupBy(F.sha2(text, 256).alias("checksum"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_doc"))
        .where("copies > 1")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one, and of distinct rows."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
            F.count(F.lit(1)).alias("unique_rows"),
        )
    )


def dedupe_hits(
    hits: DataFrame, query: str = "query_id", content: str = "text", document: str = "doc_id", rank: str = "rank"
) -> DataFrame:
    """The best-ranked hit per query, content and document."""
    return keep_first(
        hits.withColumn("_digest", F.sha2(content, 256)), [query, "_digest", document], [rank]
    ).drop("_digest")


def context_sources(
    hits: DataFrame, query: str = "query_id", source: str = "source", page: str = "page", rank: str = "rank"
) -> DataFrame:
    """Distinct (source, page) per query in order of their best rank, with the printed line."""
    return (
        hits.groupBy(query, source, page)
        .agg(F.min(rank).alias("first_rank"))
        .withColumn(
            "line",
            F.concat(
                F.lit("- "),
                F.coalesce(source, F.lit("Unknown")),
                F.when(F.col(page).isNotNull(), F.concat(F.lit(" (Page "), F.col(page).cast("string"), F.lit(")")))
                .otherwise(""),
            ),
        )
    )
