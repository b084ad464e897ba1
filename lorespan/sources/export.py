"""Writers. Every export is written by the tasks that hold the rows; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The escapes of HTML text, in order.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def escape_html(c: Column) -> Column:
    for old, new in HTML_ESCAPES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def markdown_blocks(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One Markdown block per message and a head per conversation, keyed so that sorting gives the document.

    A conversation is never collected: its blocks are rows, ordered by ``(conversation, turn)``.
    """
    body = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), "text", F.lit("\n"))
    head = F.concat(F.lit("# Conversation Export\n\n**Conversation ID:** "), F.col(conv).cast("string"), F.lit("\n\n---\n"))
    heads = messages.select(conv).distinct().select(conv, F.lit(-1).cast("long").alias(turn), head.alias("block"))
    return messages.select(conv, F.col(turn).cast("long").alias(turn), body.alias("block")).unionByName(heads)


def html_blocks(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The same as HTML, with escaped text; head before the first and foot after the last message."""
    body = F.concat(
        F.lit('<div class="'), "role", F.lit('">\n<h3>'), F.initcap("role"), F.lit("</h3>\n<p>"),
        escape_html(F.col("text")), F.lit("</p>\n</div>"),
    )
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="UTF-8">\n<title>Conversation Export</title>\n</head>\n'
              '<body>\n<h1>Conversation Export</h1>\n<p><b>Conversation ID:</b> '),
        F.col(conv).cast("string"), F.lit("</p>\n<hr>"),
    )
    ids = messages.select(conv).distinct()
    at = lambda n: F.lit(n).cast("long").alias(turn)
    return (
        messages.select(conv, F.col(turn).cast("long").alias(turn), body.alias("block"))
        .unionByName(ids.select(conv, at(-1), head.alias("block")))
        .unionByName(ids.select(conv, at(2**62), F.lit("</body>\n</html>").alias("block")))
    )


def write_documents(blocks: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", mode: str = "errorifexists") -> None:
    """Files of whole ranges of blocks, with the conversation as a column: part files in name order, and rows in file
    order, are the documents one after another.

    Range partitioning cuts a very long conversation into several files instead of sending it to one task, and many
    short ones share a file.
    """
    blocks.repartitionByRange(F.col(conv), F.col(turn)).sortWithinPartitions(conv, turn).write.mode(mode).json(path)


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str = "message") -> DataFrame:
    """Parents with their children, one flat record per child in ``name``, ordered by key and ``order``.

    A record has the same shape for a parent of any size; a parent without children has one record without a child.
    """
    fields = [c for c in children.columns if c != key]
    held = children.select(key, F.struct(*fields).alias(name))
    joined = parents.join(held, key, "left")
    return joined.repartitionByRange(F.col(key), F.col(name)[order]).sortWithinPartitions(key, F.col(name)[order])


def as_json(df: DataFrame, keys: Sequence[str], name: str = "json") -> DataFrame:
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias(name))


def save_embeddings(df: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", mode: str = "errorifexists") -> None:
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode(mode).parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_collection(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def import_collection(spark: SparkSession, *paths: str) -> DataFrame:
    """One or several dumps as one collection."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def write_exposition(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The text exposition of the metrics: part files in name order, as many names as there may be."""
    lines.orderBy("section", "name", "n").select(F.col("line").alias("value")).write.mode(mode).text(path)
