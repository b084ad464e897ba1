"""Cleaning steps: each takes a text column and returns a text column, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

from lorespan.functions.text import SPACES, let, lines, not_blank, strip

# Patterns and character tables that decide the results.
CONTROL = "[\\p{Cc}&&[^\\n\\r\\t]]"
HTML_TAG = "<[^>]+>"
URL = "(?i)https?://(?:www\\.)?[^\\s<]+"
URL_OR_WWW = "(?i)https?://\\S+|www\\.\\S+"
EMAIL = "(?U)\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b"
PHONE = "(?U)\\+?\\d{1,3}[-.\\s]?\\(?\\d{2,4}\\)?[-.\\s]?\\d{3,4}[-.\\s]?\\d{3,4}"
NUMBER = "(?U)\\b\\d+(\\.\\d+)?\\b"
PAGE_NUMBER = "(?iU)^(?:page\\s+)?\\d+$"
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}]+"
MARKDOWN = (
    "```.*?```",
    "`.*?`",
    "!\\[.*?\\]\\(.*?\\)",
    "\\[([^\\]]+)\\]\\(.*?\\)",
    "^#{1,6}\\s*",
    "[*_]{1,3}",
    "^>\\s*",
)
WATERMARKS = ("CONFIDENTIAL", "DRAFT", "COPY", "SAMPLE", "DO NOT DISTRIBUTE")
DOUBLE_QUOTES = "“”„‟"
SINGLE_QUOTES = "‘’‚‛"
DASHES = "–—―‐"
DASHES_WITH_MINUS = "–—−"
LIGATURES = {"\u00ad": "", "\ufeff": "", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
SYMBOLS = {"•": "-", "●": "-", "▪": "-", "■": "-", "→": "->", "⇒": "=>"}
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u2060"


def _sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, replacement)


def _sub_where(c: Column, needle: str, pattern: str, replacement: str) -> Column:
    """Run the pattern only over texts that hold ``needle``, without which it cannot match."""
    return let(c, lambda x: F.when(x.contains(needle), _sub(x, pattern, replacement)).otherwise(x))


def replace_text(c: Column, replacements: Mapping[str, str] | Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    pairs = replacements.items() if isinstance(replacements, Mapping) else replacements
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def apply_rules(c: Column, rules: Iterable[tuple[str, str] | tuple[str, str, str]]) -> Column:
    """User rules ``(pattern, replacement[, inline flags such as "i" or "ms"])`` in order."""

    def step(x: Column, rule) -> Column:
        pattern, replacement, flags = (*rule, "")[:3]
        return _sub(x, f"(?{flags}){pattern}" if flags else pattern, replacement)

    return reduce(step, rules, c)


def remove_control_characters(c: Column) -> Column:
    return _sub(c, CONTROL, "")


def normalize_line_endings(c: Column) -> Column:
    return _sub(c, "\\r\\n?", "\n")


def strip_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), strip), "\n")


def normalize_whitespace(c: Column) -> Column:
    return _sub(c, "[ \\t]+", " ")


def normalize_whitespace_and_newlines(c: Column) -> Column:
    return _sub(normalize_whitespace(c), "\\n{3,}", "\n\n")


def remove_empty_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: strip(x) != ""), "\n")


def collapse_newlines(c: Column, maximum: int = 2) -> Column:
    keep = max(1, maximum)
    return _sub(c, "\\n{%d,}" % (keep + 1), "\n" * keep)


def remove_html_tags(c: Column) -> Column:
    return _sub(c, HTML_TAG, " ")


def remove_markdown(c: Column) -> Column:
    """Fences, code, images, links (with their text), heading marks, emphasis and quotes become a blank."""
    return reduce(lambda x, p: _sub(x, "(?msdU)" + p, " "), MARKDOWN, c)


def remove_urls(c: Column, replacement: str = "") -> Column:
    return _sub_where(c, "://", URL, replacement)


def normalize_urls(c: Column, replacement: str = "<URL>") -> Column:
    return _sub(c, URL_OR_WWW, replacement)


def remove_emails(c: Column, replacement: str = "") -> Column:
    return _sub_where(c, "@", EMAIL, replacement)


def normalize_emails(c: Column, replacement: str = "<EMAIL>") -> Column:
    return _sub_where(c, "@", EMAIL, replacement)


def normalize_phone_numbers(c: Column, replacement: str = "<PHONE>") -> Column:
    return _sub(c, PHONE, replacement)


def normalize_numbers(c: Column, replacement: str = "<NUMBER>") -> Column:
    return _sub(c, NUMBER, replacement)


def normalize_quotes(c: Column) -> Column:
    return F.translate(c, DOUBLE_QUOTES + SINGLE_QUOTES, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))


def normalize_dashes(c: Column, dashes: str = DASHES) -> Column:
    return F.translate(c, dashes, "-" * len(dashes))


def remove_repeated_spaces(c: Column) -> Column:
    return _sub(c, " {2,}", " ")


def normalize_punctuation(c: Column) -> Column:
    return _sub(_sub(_sub(c, "!{2,}", "!"), "\\?{2,}", "?"), "\\.{4,}", "...")


def squeeze_punctuation(c: Column) -> Column:
    """The stricter form: mixed ``!?`` runs become ``!``, comma runs one comma, three or more dots ``...``."""
    return _sub(_sub(_sub(c, "[!?]{2,}", "!"), "\\.{3,}", "..."), ",{2,}", ",")


def normalize_symbols(c: Column) -> Column:
    return replace_text(c, SYMBOLS)


def clean_ocr_noise(c: Column) -> Column:
    return _sub(replace_text(c, LIGATURES), "(?U)(?<=\\b[A-Za-z])\\s+(?=[A-Za-z]\\b)", " ")


def remove_blank_characters(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def remove_page_numbers(c: Column) -> Column:
    """Drop lines that hold only a page number."""
    return F.array_join(F.filter(lines(c), lambda x: ~strip(x).rlike(PAGE_NUMBER)), "\n")


def blank_page_numbers(c: Column) -> Column:
    """The in-place form: the number is removed with the white space around it."""
    return _sub(c, "(?imdU)^\\s*(page\\s*)?\\d+\\s*$", "")


def fix_hyphenation(c: Column) -> Column:
    return _sub(c, "([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])", "$1$2")


def merge_paragraphs(c: Column) -> Column:
    return _sub(c, "(?<!\\n)\\n(?!\\n)", " ")


def remove_watermarks(c: Column) -> Column:
    return reduce(lambda x, w: _sub(x, "(?i)" + w, ""), WATERMARKS, c)


def remove_table_artifacts(c: Column) -> Column:
    return _sub(_sub(c, "[-=]{3,}", " "), "\\|{2,}", "|")


def remove_emojis(c: Column, replacement: str = "") -> Column:
    return _sub(c, EMOJI, replacement)


def lowercase(c: Column) -> Column:
    return F.lower(c)


def normalize_paragraphs(c: Column, preserve: bool = True) -> Column:
    parts = F.transform(not_blank(F.split(c, "(?U)\\n\\s*\\n+")), lambda p: _sub(p, SPACES, " "))
    return F.array_join(parts, "\n\n" if preserve else "\n")


def normalize_sentences(c: Column) -> Column:
    spaced = _sub(_sub(c, "(?U)\\s+([,.!?;:])", "$1"), "([.!?])([A-Za-z])", "$1 $2")
    return strip(_sub(spaced, " {2,}", " "))


def split_sentences(c: Column) -> Column:
    """Sentences after the spacing around marks has been put right."""
    from lorespan.functions.text import sentences

    return sentences(normalize_sentences(c))


def split_paragraphs(c: Column) -> Column:
    return not_blank(F.split(c, "(?U)\\n\\s*\\n+"))


def _keyed_lines(c: Column, key) -> Column:
    return F.transform(lines(c), lambda x, i: F.struct(key(strip(x)).alias("k"), i.alias("i"), x.alias("x")))


def _join_in_order(kept: Column) -> Column:
    ordered = F.sort_array(F.transform(kept, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
    return F.array_join(F.transform(ordered, lambda r: r["x"]), "\n")


def _same(a: Column) -> Column:
    return a


def remove_duplicate_lines(c: Column, case_sensitive: bool = False, drop_blank: bool = False) -> Column:
    """Keep the first of equal lines. Sorting by (line, position) inside the row replaces a shuffle of all lines."""
    key = _same if case_sensitive else F.lower

    def first_of_run(rows: Column) -> Column:
        fresh = lambda r, i: (i == 0) | (r["k"] != F.try_element_at(rows, F.greatest(i, F.lit(1)))["k"])
        if drop_blank:
            return F.filter(rows, lambda r, i: (r["k"] != "") & fresh(r, i))
        return F.filter(rows, lambda r, i: (r["k"] == "") | fresh(r, i))

    return _join_in_order(let(F.sort_array(_keyed_lines(c, key)), first_of_run))


def repeated_lines(c: Column, minimum: int = 2, case_sensitive: bool = False) -> Column:
    """Keys (stripped lines, lower case unless case sensitive) that occur at least ``minimum`` times."""
    key = _same if case_sensitive else F.lower
    keys = F.sort_array(F.filter(F.transform(lines(c), lambda x: key(strip(x))), lambda k: k != ""))
    nth = lambda ks: F.filter(ks, lambda k, i: k == F.try_element_at(ks, i + minimum))
    return F.array_distinct(let(keys, nth))


def remove_repeated_lines(c: Column, minimum: int = 3, case_sensitive: bool = False, minimum_lines: int = 0) -> Column:
    """Delete lines that occur at least ``minimum`` times (running headers and footers)."""
    key = _same if case_sensitive else F.lower

    def singles(rows: Column) -> Column:
        # In sorted order equal keys are neighbours: a run is long if one of the windows of ``minimum`` rows
        # around the row holds equal keys at both ends.
        def long_run(r: Column, i: Column) -> Column:
            tests = [
                F.coalesce(
                    (i >= back)
                    & (F.try_element_at(rows, F.greatest(i + 1 - back, F.lit(1)))["k"] == r["k"])
                    & (F.try_element_at(rows, i + minimum - back)["k"] == r["k"]),
                    F.lit(False),
                )
                for back in range(minimum)
            ]
            return reduce(lambda a, b: a | b, tests)

        return F.filter(rows, lambda r, i: (r["k"] == "") | ~long_run(r, i))

    cleaned = _join_in_order(let(F.sort_array(_keyed_lines(c, key)), singles))
    # Without a repeated line the text is returned unchanged, its line ends included.
    changed = F.size(repeated_lines(c, minimum, case_sensitive)) > 0
    if minimum_lines:
        changed = changed & (F.size(lines(c)) >= minimum_lines)
    return F.when(changed, cleaned).otherwise(c)


def remove_stopwords(c: Column, stop: Iterable[str]) -> Column:
    """Drop words of ``stop`` (lower case); the set is hashed once per task."""
    from lorespan.functions.text import words

    listed = list(stop)
    return F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(listed)), " ")
