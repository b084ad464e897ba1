"""Corpus cleaning: documents in, cleaned documents out, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import cleaning as c, text as t, unicode as u


def clean_basic(x: Column, *, unicode: bool = True, remove_empty_lines: bool = True) -> Column:
    """NFKC, entities, control characters, line ends, white space, line trim, blank lines, outer trim.

    Blank lines go by default, so paragraphs are only kept with ``remove_empty_lines=False``.
    """
    x = u.normalize_and_decode(x) if unicode else x
    x = c.normalize_line_endings(c.remove_control_characters(x))
    x = c.collapse_newlines(c.strip_lines(c.normalize_whitespace(x)))
    x = c.remove_empty_lines(x) if remove_empty_lines else x
    return t.strip(c.remove_repeated_spaces(x))


def clean_advanced(
    x: Column,
    *,
    unicode: bool = True,
    remove_empty_lines: bool = True,
    remove_links: bool = False,
    remove_email_addresses: bool = False,
    remove_duplicates: bool = False,
    remove_page_numbers: bool = False,
    remove_headers_footers: bool = False,
    clean_ocr: bool = True,
    rules: Iterable[tuple] = (),
) -> Column:
    x = clean_basic(x, unicode=unicode, remove_empty_lines=remove_empty_lines)
    x = c.normalize_dashes(c.normalize_quotes(c.remove_html_tags(x)))
    x = c.remove_urls(x) if remove_links else x
    x = c.remove_emails(x) if remove_email_addresses else x
    x = c.clean_ocr_noise(x) if clean_ocr else x
    x = c.normalize_punctuation(x)
    x = c.remove_page_numbers(x) if remove_page_numbers else x
    if remove_headers_footers:
        x = t.let(x, lambda y: c.remove_repeated_lines(y))
    x = c.remove_duplicate_lines(x) if remove_duplicates else x
    x = c.apply_rules(x, rules)
    return t.strip(c.collapse_newlines(c.normalize_whitespace(x)))


def text_statistics(x: Column) -> dict[str, Column]:
    """Counts of one text. ``x`` should be a plain column: it is read once per count."""
    n_words = F.regexp_count(x, F.lit(t.WORD)).cast("long")
    word_chars = F.length(F.regexp_replace(x, t.NOT_WORD, ""))
    n_sentences = F.size(c.split_sentences(x)).cast("long")
    return {
        "characters": F.length(x).cast("long"),
        "characters_without_spaces": F.length(F.regexp_replace(x, t.SPACES, "")).cast("long"),
        "words": n_words,
        "sentences": n_sentences,
        "paragraphs": F.size(c.split_paragraphs(x)).cast("long"),
        "lines": F.size(F.filter(t.lines(x), lambda l: t.strip(l) != "")).cast("long"),
        "average_word_length": F.round(t.share(word_chars, n_words), 2),
        "average_sentence_length": F.round(t.share(n_words, n_sentences), 2),
    }


def validation(x: Column) -> dict[str, Column]:
    s = t.strip(x)
    return {
        "valid": s != "",
        "empty": s == "",
        "character_count": F.length(s).cast("long"),
        "word_count": F.regexp_count(s, F.lit(t.WORD)).cast("long"),
        "has_html": s.rlike("<[^>]+>"),
        "has_urls": s.rlike("(?U)https?://\\S+"),
        "has_excessive_spaces": s.rlike("[ \\t]{2,}"),
        "has_excessive_newlines": s.rlike("\\n{3,}"),
    }


def clean_documents(
    df: DataFrame,
    text: str = "text",
    *,
    replacements: Mapping[str, str] | None = None,
    statistics: bool = True,
    **flags,
) -> DataFrame:
    """Add ``clean_text``, its lengths and (unless switched off) its statistics and validation flags."""
    x = clean_advanced(F.col(text), **flags)
    x = c.remove_blank_characters(x)
    x = c.replace_text(x, replacements) if replacements else x
    x = c.normalize_sentences(c.normalize_paragraphs(x))
    out = df.withColumn("clean_text", x)
    measures = {
        "original_length": F.length(text).cast("long"),
        "cleaned_length": F.length("clean_text").cast("long"),
    }
    if statistics:
        measures |= text_statistics(F.col("clean_text")) | validation(F.col("clean_text"))
    return out.select("*", *[v.alias(k) for k, v in measures.items()])


def preprocess(
    x: Column,
    *,
    unicode: bool = True,
    html: bool = True,
    markdown: bool = True,
    whitespace: bool = True,
    empty_lines: bool = True,
    lower: bool = False,
) -> Column:
    """NFKC, entities, HTML, Markdown, white space, blank lines, lower case: the steps before embedding."""
    x = u.normalize_and_decode(x) if unicode else u.decode_html_entities(x)
    x = c.remove_html_tags(x) if html else x
    x = c.remove_markdown(x) if markdown else x
    x = c.normalize_whitespace_and_newlines(x) if whitespace else x
    x = F.array_join(F.filter(t.lines(x), lambda l: t.strip(l) != ""), "\n") if empty_lines else x
    x = F.lower(x) if lower else x
    return t.strip(x)


def validate_texts(df: DataFrame, text: str = "text", minimum: int = 1) -> DataFrame:
    """Add ``reject_reason``: null where the text may be cleaned."""
    x = F.col(text)
    return df.withColumn(
        "reject_reason",
        F.when(x.isNull(), "not a text").when((x != "") & (F.length(x) < minimum), "shorter than the minimum"),
    )


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """Corpus totals of a ``clean_documents`` result."""
    before, after = F.sum("original_length"), F.sum("cleaned_length")
    removed = F.greatest(F.lit(0), before - after)
    return cleaned.agg(
        F.count(F.lit(1)).alias("documents_cleaned"),
        F.coalesce(before, F.lit(0)).alias("characters_before"),
        F.coalesce(after, F.lit(0)).alias("characters_after"),
        F.coalesce(removed, F.lit(0)).alias("characters_removed"),
        F.coalesce(F.round(removed / before * 100, 2), F.lit(0.0)).alias("reduction_percent"),
        F.coalesce(
            F.sum(F.greatest(F.lit(0), F.col("original_length") - F.col("cleaned_length"))), F.lit(0)
        ).alias("spaces_removed"),
    )


# Language tags of Spark's stop word lists.
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}


def default_stop_words() -> dict[str, list[str]]:
    return {tag: sorted(set(StopWordsRemover.loadDefaultStopWords(name))) for tag, name in LANGUAGES.items()}


def remove_stopwords(
    df: DataFrame,
    text: str = "text",
    language: str = "lang",
    name: str = "content_text",
    lists: Mapping[str, list[str]] | None = None,
) -> DataFrame:
    """Drop the stop words of each row's language; other languages keep all words.

    The lists are constants of the plan (hash sets per task), so no join is needed.
    """
    out = F.array_join(t.words(F.col(text)), " ")
    for tag, listed in (lists or default_stop_words()).items():
        out = F.when(F.col(language) == tag, c.remove_stopwords(F.col(text), listed)).otherwise(out)
    return df.withColumn(name, out)


def detect_language(
    df: DataFrame, text: str = "text", name: str = "detected", lists: Mapping[str, list[str]] | None = None
) -> DataFrame:
    """The language with most stop words among the words of the text, ``unknown`` without any.

    Ties go to the tag that sorts first. Counting is local to the row.
    """
    lists = lists or default_stop_words()
    tags = sorted(lists)
    votes = df.withColumn("_w", t.tokens(F.col(text)))

    def count(listed: list[str]) -> Column:
        return F.size(F.filter("_w", lambda w: w.isin(listed)))

    votes = votes.select("*", *[count(list(lists[tag])).alias(f"_n_{tag}") for tag in tags])
    best = F.greatest(*[F.col(f"_n_{tag}") for tag in tags])
    pick = F.lit("unknown")
    for tag in reversed(tags):
        pick = F.when((F.col(f"_n_{tag}") == best) & (best > 0), tag).otherwise(pick)
    return votes.withColumn(name, pick).drop("_w", *[f"_n_{tag}" for tag in tags])
