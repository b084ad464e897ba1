"""Text expressions. Everything here stays in the JVM and is local to its row.

Patterns are meant to be Unicode aware, Java's are not by default: ``(?U)`` or explicit
``\\p{..}`` classes are used throughout. A word character is a letter, a number or an underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters that count as white space, and those that end a line.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
SPACES = "(?U)\\s+"
WORD = "[\\p{L}\\p{N}_]+"
NOT_WORD = "[^\\p{L}\\p{N}_]"
SENTENCE_END = "(?U)(?<=[.!?])\\s+"
PARAGRAPH_GAP = "(?U)\\n\\s*\\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column used inside a lambda would otherwise be evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def not_blank(parts: Column) -> Column:
    """Pieces stripped of surrounding white space, empty ones dropped."""
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?U)\\S+")).cast("long")


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, an empty text has no line."""
    parts = F.split(c, LINE_BREAK)
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def line_count(c: Column) -> Column:
    return F.size(lines(c)).cast("long")


def sentences(c: Column) -> Column:
    """Pieces that end in ``.``, ``!`` or ``?`` followed by white space."""
    return not_blank(F.split(c, SENTENCE_END))


def paragraphs(c: Column) -> Column:
    """Pieces between blank lines."""
    return not_blank(F.split(c, PARAGRAPH_GAP))


def sentence_count(c: Column) -> Column:
    """Non-blank pieces between runs of sentence marks."""
    return F.size(F.filter(F.split(c, "[.!?]+"), lambda p: strip(p) != "")).cast("long")


def regex_words(c: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"))


def collapse(c: Column) -> Column:
    """Lower case, white space runs as one blank."""
    return strip(F.regexp_replace(F.lower(c), SPACES, " "))


def normalize(c: Column) -> Column:
    """Lower case, punctuation dropped, white space runs as one blank."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), "(?U)[^\\p{L}\\p{N}_\\s]", ""), SPACES, " "))


def tokens(c: Column) -> Column:
    """Words of the normalised text."""
    return F.filter(F.split(normalize(c), " "), lambda w: w != "")


def token_estimate(c: Column, method: str = "chars4") -> Column:
    """Estimated number of tokens.

    ``chars4``: a quarter of the characters, at least 1. ``chars4_or_zero``: the same, 0 for empty text.
    ``chars4_floor``: a quarter, no minimum. ``words``: words, at least 1. ``words13``: 1.3 per word, at least 1.
    """
    quarter = F.floor(F.length(c) / 4).cast("long")
    if method == "chars4":
        return F.greatest(F.lit(1).cast("long"), quarter)
    if method == "chars4_or_zero":
        return F.when(F.length(c) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), quarter))
    if method == "chars4_floor":
        return quarter
    if method == "words":
        return F.greatest(F.lit(1).cast("long"), word_count(c))
    if method == "words13":
        return F.greatest(F.lit(1).cast("long"), F.floor(word_count(c) * F.lit(13) / F.lit(10)).cast("long"))
    raise ValueError(f"unknown token estimate: {method}")


def preview(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(tail)))


def contains_ci(c: Column, keyword: str) -> Column:
    return F.lower(c).contains(keyword.lower())


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``part / whole`` as double, ``empty`` where ``whole`` is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / whole)


def runs(ordered: Column) -> Column:
    """Runs of equal neighbours in a sorted array: ``array<struct<value, copies>>``, in linear time."""

    def cut(xs: Column) -> Column:
        starts = F.filter(
            F.transform(xs, lambda x, i: F.when((i == 0) | (x != F.try_element_at(xs, F.greatest(i, F.lit(1)))), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda ss: F.transform(
                ss,
                lambda s, j: F.struct(
                    F.element_at(xs, s + 1).alias("value"),
                    (F.coalesce(F.try_element_at(ss, j + 2), F.size(xs)) - s).cast("long").alias("copies"),
                ),
            ),
        )

    return let(ordered, cut)
