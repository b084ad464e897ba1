"""Markdown structure: headings, code, lists, tables, links, front matter, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t

# The patterns that define the structure.
HEADING = "(?mdU)^(#{1,6})\\s+(.*)$"
HEADING_CUT = "(?mdU)(?=^#{1,6}\\s+.*$)"
FENCE = "(?sd)```([\\p{L}\\p{N}_]+)?\\n(.*?)```"
LIST_ITEM = "(?mdU)^\\s*[-*+]\\s+(.*)$"
LINK = "\\[(.*?)\\]\\((.*?)\\)"
IMAGE = "!\\[(.*?)\\]\\((.*?)\\)"
FRONT_MATTER = "(?sd)^---\\n(.*?)\\n---"


def _all(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), group)


def _pairs(df: DataFrame, key: str, x: Column, pattern: str, left: str, right: str) -> DataFrame:
    zipped = F.arrays_zip(_all(x, pattern, 1).alias("a"), _all(x, pattern, 2).alias("b"))
    return df.select(key, F.posexplode(zipped).alias("n", "_z")).select(
        key,
        (F.col("n") + 1).cast("long").alias("n"),
        F.col("_z").getField("a").alias(left),
        F.col("_z").getField("b").alias(right),
    )


def headings(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    found = _pairs(df, key, F.col(text), HEADING, "marks", "title")
    return found.select(key, "n", F.length("marks").cast("long").alias("level"), t.strip(F.col("title")).alias("title"))


def code_blocks(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fenced blocks with their language (``text`` if none is named)."""
    found = _pairs(df, key, F.col(text), FENCE, "language", "code")
    return found.select(
        key,
        "n",
        F.when(F.coalesce("language", F.lit("")) == "", "text").otherwise(F.col("language")).alias("language"),
        t.rstrip(F.col("code")).alias("code"),
    )


def list_items(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    items = F.transform(_all(F.col(text), LIST_ITEM, 1), t.strip)
    return df.select(key, F.posexplode(items).alias("n", "item")).withColumn("n", (F.col("n") + 1).cast("long"))


def table_texts(x: Column) -> Column:
    """Runs of consecutive lines that contain ``|``."""

    def runs(ls: Column) -> Column:
        has = lambda i: F.coalesce(F.try_element_at(ls, i).contains("|"), F.lit(False))
        # Positions (from 1) where a run starts and where it ends.
        numbers = F.sequence(F.lit(1), F.size(ls))
        begins = F.filter(numbers, lambda i: has(i) & ((i == 1) | ~has(F.greatest(i - 1, F.lit(1)))))
        ends = F.filter(numbers, lambda i: has(i) & ~has(i + 1))
        return F.zip_with(begins, ends, lambda a, b: F.array_join(F.slice(ls, a, b - a + 1), "\n"))

    empty = F.array().cast("array<string>")
    return t.let(t.lines(x), lambda ls: F.when(F.size(ls) > 0, runs(ls)).otherwise(empty))


def tables(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode(table_texts(F.col(text))).alias("n", "table_text")).withColumn(
        "n", (F.col("n") + 1).cast("long")
    )


def links(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return _pairs(df, key, F.col(text), LINK, "text", "url")


def images(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return _pairs(df, key, F.col(text), IMAGE, "alt", "path")


def front_matter(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Flat ``key: value`` pairs of the block at the start."""
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    lines = F.filter(F.split(block, "\n"), lambda l: l.contains(":"))
    pairs = F.transform(
        lines,
        lambda l: F.struct(
            t.strip(F.substring_index(l, ":", 1)).alias("name"),
            t.strip(F.regexp_replace(l, "^[^:]*:", "")).alias("value"),
        ),
    )
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def section_structs(x: Column) -> Column:
    """``array<struct<heading,level,content>>``; a text without headings is one section of level 0."""
    parts = F.filter(F.split(x, HEADING_CUT), lambda p: p.rlike(HEADING))

    def section(p: Column) -> Column:
        return F.struct(
            t.strip(F.regexp_extract(p, HEADING, 2)).alias("heading"),
            F.length(F.regexp_extract(p, HEADING, 1)).cast("long").alias("level"),
            t.strip(F.regexp_replace(p, "(?dU)^#{1,6}\\s+.*", "")).alias("content"),
        )

    whole = F.array(
        F.struct(
            F.lit(None).cast("string").alias("heading"),
            F.lit(0).cast("long").alias("level"),
            x.alias("content"),
        )
    )
    return F.when(x.rlike(HEADING), F.transform(parts, section)).otherwise(whole)


def sections(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode(section_structs(F.col(text))).alias("n", "s")).select(
        key, (F.col("n") + 1).cast("long").alias("n"), "s.*"
    )


def search_sections(df: DataFrame, keyword: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sections whose body contains the keyword, with a preview of 300 characters."""
    return (
        sections(df, text, key)
        .where(t.contains_ci(F.col("content"), keyword))
        .select(key, "n", "heading", "level", F.substring("content", 1, 300).alias("preview"))
    )


def plain_text(x: Column) -> Column:
    """Markdown marks dropped, the words of links and code kept."""
    for pattern, to in (
        ("(?sd)^---\\n.*?\\n---\\n?", ""),
        ("(?md)^```.*$\\n?", ""),
        ("`([^`]*)`", "$1"),
        ("!\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
        ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
        ("(?md)^#{1,6}\\s+", ""),
        ("(?md)^\\s*[-*+]\\s+", ""),
        ("(?md)^>\\s?", ""),
        ("[*_]{1,3}([^*_\\n]+)[*_]{1,3}", "$1"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return t.strip(x)


def markdown_statistics(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of characters, words, lines, headings, sections, tables, links, images, code blocks and list items."""
    x = F.col(text)
    n = lambda pattern: F.regexp_count(x, F.lit(pattern)).cast("long")
    return df.select(
        key,
        F.length(x).cast("long").alias("characters"),
        t.word_count(x).alias("words"),
        t.line_count(x).alias("lines"),
        n(HEADING).alias("headings"),
        F.greatest(n(HEADING), F.lit(1)).cast("long").alias("sections"),
        F.size(table_texts(x)).cast("long").alias("tables"),
        n(LINK).alias("links"),
        n(IMAGE).alias("images"),
        n(FENCE).alias("code_blocks"),
        n(LIST_ITEM).alias("lists"),
    )
