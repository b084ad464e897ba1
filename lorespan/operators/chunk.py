"""Documents -> chunks (1:n). All strategies are row-local expressions followed by one ``posexplode``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import chunking as k, text as t

# Strategies whose offsets are running lengths, with the gap counted between chunks.
_GAPS = {"sentence": 1, "paragraph": 2, "token": 1, "heading": 0, "code": 0}


def _texts(strategy: str, x: Column, opts: dict) -> Column:
    makers = {
        "sentence": k.sentence_chunks,
        "paragraph": k.paragraph_chunks,
        "recursive": k.recursive_chunks,
        "token": k.token_blocks,
        "heading": k.heading_chunks,
        "code": k.code_chunks,
        "characters": k.split_characters,
        "words": k.split_words,
        "windows": k.token_windows,
        "separator": k.split_by_separator,
        "sentences": t.sentences,
        "paragraphs": t.paragraphs,
        "token_split": k.token_split,
        "recursive_split": k.recursive_split,
        "hierarchy": k.separator_chunks,
        "html": k.split_html,
        "json": k.split_json,
        "csv": k.split_csv,
        "yaml": k.split_yaml,
        "sql": k.split_sql,
        "logs": k.split_logs,
        "source_code": k.split_code,
    }
    if strategy not in makers:
        raise ValueError(f"unknown strategy: {strategy}")
    return makers[strategy](x, **opts)


def _with_offsets(texts: Column, gap: int) -> Column:
    """Add running start and end offsets to an array of chunk texts."""
    empty = F.struct(
        F.array().cast("array<struct<text:string,start_char:bigint,end_char:bigint>>").alias("out"),
        F.lit(0).cast("long").alias("at"),
    )

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        span = F.struct(x.alias("text"), acc["at"].alias("start_char"), end.alias("end_char"))
        return F.struct(F.array_append(acc["out"], span).alias("out"), (end + gap).alias("at"))

    return F.aggregate(texts, empty, step, lambda a: a["out"])


def chunk_spans(strategy: str, x: Column, **opts) -> Column:
    """``array<struct<text,start_char,end_char>>``; offsets are null where the strategy has none."""
    if strategy == "fixed":
        return k.fixed_spans(x, **opts)
    texts = _texts(strategy, x, opts)
    if strategy in _GAPS:
        return _with_offsets(texts, _GAPS[strategy])
    none = F.lit(None).cast("long")
    return F.transform(texts, lambda p: F.struct(p.alias("text"), none.alias("start_char"), none.alias("end_char")))


def explode_spans(df: DataFrame, spans: Column, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk with its index, offsets and counts."""
    return (
        df.select(key, *carry, F.posexplode(spans).alias("chunk_index", "_c"))
        .select(key, *carry, F.col("chunk_index").cast("long").alias("chunk_index"), "_c.*")
        .withColumn("token_count", t.token_estimate(F.col("text"), "words"))
        .withColumn("word_count", t.word_count(F.col("text")))
    )


def chunk_documents(
    df: DataFrame,
    strategy: str = "recursive",
    *,
    key: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    **opts,
) -> DataFrame:
    """``(key, carried columns, chunk_index, text, start_char, end_char, token_count, word_count)``."""
    return explode_spans(df, chunk_spans(strategy, F.col(text), **opts), key, carry)


def chunk_texts(df: DataFrame, texts: Column, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of an array of texts, without counts."""
    return df.select(key, *carry, F.posexplode(texts).alias("chunk_index", "text")).withColumn(
        "chunk_index", F.col("chunk_index").cast("long")
    )


def chunk_files(files: DataFrame, text: str = "value", key: str = "path") -> DataFrame:
    """Cut each file with the splitter of its extension."""
    ext = F.lower(F.regexp_extract(key, "\\.([A-Za-z0-9]+)$", 1))
    return chunk_texts(files, k.split_file(F.col(text), ext), key)


def with_overlap(texts: Column, words: int = 50) -> Column:
    """Put the last ``words`` words of the previous chunk in front of each chunk of the array."""

    def one(x: Column, i: Column, all_: Column) -> Column:
        tail = lambda w: F.slice(w, F.greatest(F.size(w) - words + 1, F.lit(1)), words)
        previous = t.let(t.words(F.element_at(all_, F.greatest(i, F.lit(1)))), tail)
        return F.when(i == 0, x).otherwise(F.array_join(F.concat(previous, t.words(x)), " "))

    return t.let(texts, lambda all_: F.transform(all_, lambda x, i: one(x, i, all_)))


def merge_small_spans(spans: Column, minimum: int = 120) -> Column:
    """Merge chunks with offsets: the next one is joined by a line break while the current is below ``minimum``."""
    kind = "struct<text:string,start_char:bigint,end_char:bigint>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast(kind).alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        cur = acc["cur"]
        joins = cur.isNotNull() & (F.length(cur["text"]) < minimum)
        joined = F.struct(
            F.concat(cur["text"], F.lit("\n"), s["text"]).alias("text"),
            cur["start_char"].alias("start_char"),
            s["end_char"].alias("end_char"),
        )
        return F.struct(
            F.when(cur.isNull() | joins, acc["out"]).otherwise(F.array_append(acc["out"], cur)).alias("out"),
            F.when(joins, joined).otherwise(s.cast(kind)).alias("cur"),
        )

    end = lambda a: F.when(a["cur"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["cur"]))
    return F.aggregate(spans, start, step, end)


def build_metadata(
    df: DataFrame, strategy: str, name: str = "source", key: str = "doc_id", text: str = "text", **opts
) -> DataFrame:
    """Chunk facts for the index: document, file, index, total, characters, words.

    The total is the length of the row's own array of chunks, so nothing is counted, joined or shuffled.
    """
    spans = t.let(
        chunk_spans(strategy, F.col(text), **opts),
        lambda ss: F.transform(ss, lambda s: F.struct(s["text"].alias("text"), F.size(ss).alias("total"))),
    )
    return df.select(key, name, F.posexplode(spans).alias("chunk_index", "_c")).select(
        key,
        name,
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("_c.total").cast("long").alias("total_chunks"),
        F.length("_c.text").cast("long").alias("characters"),
        t.word_count(F.col("_c.text")).alias("words"),
    )


def validate_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: no blank chunk, no start after its end, positive counts."""
    good = (
        (t.strip(F.col("text")) != "")
        & F.coalesce(F.col("start_char") <= F.col("end_char"), F.lit(True))
        & (F.col("word_count") > 0)
        & (F.col("token_count") > 0)
    )
    return chunks.groupBy(key).agg(F.bool_and(good).alias("valid"))


def filter_by_length(chunks: DataFrame, minimum: int = 30, text: str = "text") -> DataFrame:
    return chunks.where(F.length(text) >= minimum)


def remove_empty(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.where(t.strip(F.col(text)) != "")


def sort_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.orderBy(key, "chunk_index")


def chunk_statistics(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of chunks with mean and extreme token, word and character counts."""
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.round(F.avg("token_count"), 6).alias("avg_tokens"),
        F.round(F.avg("word_count"), 6).alias("avg_words"),
        F.max("token_count").alias("max_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.sum(F.length("text")).alias("characters"),
    )
