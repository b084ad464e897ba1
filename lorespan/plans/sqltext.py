"""SQL fragments shared by the checking queries (RE2 has no lookaround, so cuts are marked first)."""

from __future__ import annotations

TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {TRIM})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '\\S+')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def cut(x: str, pattern: str, keep: str = "") -> str:
    """Split ``x`` at ``pattern``; ``keep`` is the replacement part that stays in front of the cut."""
    return f"string_split(regexp_replace({x}, '{pattern}', '{keep}' || chr(1), 'g'), chr(1))"


def not_blank(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')"


def sentences(x: str) -> str:
    return not_blank(cut(x, r"([.!?])\s+", r"\1"))


def paragraphs(x: str) -> str:
    return not_blank(cut(x, r"\n\s*\n"))


def lines(x: str) -> str:
    nl = f"string_split(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    return f"(case when {x} = '' then [] when right({x}, 1) in (chr(10), chr(13)) then ({nl})[:-2] else {nl} end)"


def join(parts: str, sep: str = "' '") -> str:
    return f"coalesce(array_to_string({parts}, {sep}), '')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace(lower({x}), '\\s+', ' ', 'g')")


def normalize(x: str) -> str:
    return strip(
        f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')"
    )


def tokens(x: str) -> str:
    return f"list_filter(string_split({normalize(x)}, ' '), lambda w: w <> '')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(x: str, places: int) -> str:
    """Half up on the decimal rendering of a double, as Spark rounds."""
    return f"round(({x})::double::varchar::decimal(38, 22), {places})::double"


def exact_mean(x: str, places: int) -> str:
    """Mean of a non-negative column in exact integers, rounded half up; for values with at most six places."""
    total, unit = f"sum(round({x} * 1000000)::hugeint)", 10 ** (6 - places)
    return f"(((2 * {total} + count(*) * {unit}) // (2 * count(*) * {unit}))::double / {10**places})"
