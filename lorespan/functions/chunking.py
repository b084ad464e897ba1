"""Text column -> array of chunk texts. Row-local, so chunking a corpus needs no shuffle.

Greedy packing folds over piece *lengths* and remembers only where chunks start; the text itself is
joined once per chunk, which keeps long documents linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from lorespan.functions.text import SENTENCE_END, let, not_blank, paragraphs, sentences, strip, words

# Where structured texts are cut.
HEADING_CUT = "(?mdU)(?=^#{1,6}\\s)"
CODE_CUT = "(?mdU)(?=^\\s*(?:def|class)\\s+)"
YAML_CUT = "(?mdU)^---\\s*$"
SQL_CUT = "(?U);\\s*\\n"
LOG_CUT = "\\n(?=\\d{4}-\\d{2}-\\d{2})"
SEPARATOR_CUTS = ("(?=\\n\\n)", "(?=\\n)", "(?=\\. )", "(?= )")

def _starts(total: Column, step: int) -> Column:
    return F.when(total > 0, F.sequence(F.lit(0), total.cast("int") - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def split_characters(c: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Character windows that start every ``size - overlap`` characters; stripped, blank ones dropped."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    return not_blank(F.transform(_starts(F.length(c), size - overlap), lambda i: F.substring(c, i + 1, F.lit(size))))


def fixed_spans(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """``struct<text,start_char,end_char>`` windows; the first one that reaches the end is the last."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    n = F.length(c)
    last = F.greatest(n - overlap, F.lit(1))
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), last - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            strip(F.substring(c, i + 1, F.lit(size))).alias("text"),
            i.cast("long").alias("start_char"),
            F.least(i + size, n).cast("long").alias("end_char"),
        ),
    )


def fixed(c: Column, size: int = 500, overlap: int = 50) -> Column:
    return F.transform(fixed_spans(c, size, overlap), lambda s: s["text"])


def split_words(c: Column, size: int = 200, overlap: int = 20) -> Column:
    """Word windows that start every ``size - overlap`` words."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    return let(
        words(c),
        lambda w: F.transform(
            _starts(F.size(w), size - overlap), lambda i: F.array_join(F.slice(w, i + 1, size), " ")
        ),
    )


def token_windows(c: Column, max_tokens: int = 512, overlap: int = 256) -> Column:
    """Word windows with overlap; a text that fits is returned whole."""
    from lorespan.functions.text import word_count

    return F.when(word_count(c) <= max_tokens, F.array(c)).otherwise(split_words(c, max_tokens, overlap))


def token_blocks(c: Column, max_tokens: int = 500) -> Column:
    return split_words(c, max_tokens, 0)


def pack(
    pieces: Column,
    weight: Callable[[Column], Column],
    fits: Callable[[Column, Column], Column],
    grow: Callable[[Column, Column], Column],
    first: Callable[[Column], Column] | None = None,
    separator: str = " ",
) -> Column:
    """Join consecutive pieces while ``fits(current weight, next weight)`` holds.

    ``grow`` gives the weight after joining, ``first`` the weight of the very first piece.
    """
    first = first or (lambda w: w)
    zero = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("cur"), F.lit(0).alias("i")
    )

    def step(acc: Column, piece: Column) -> Column:
        def place(w: Column) -> Column:
            opens = (F.size(acc["starts"]) == 0) | ~fits(acc["cur"], w)
            started = F.when(F.size(acc["starts"]) == 0, first(w)).otherwise(w)
            return F.struct(
                F.when(opens, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"),
                F.when(opens, started).otherwise(grow(acc["cur"], w)).cast("long").alias("cur"),
                (acc["i"] + 1).alias("i"),
            )

        return let(weight(piece).cast("long"), place)

    def join(ps: Column) -> Column:
        def cut(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda s, j: F.array_join(
                    F.slice(ps, s + 1, F.coalesce(F.try_element_at(starts, j + 2), F.size(ps)) - s), separator
                ),
            )

        return let(F.aggregate(ps, zero, step, lambda a: a["starts"]), cut)

    return let(pieces, join)


def sentence_chunks(c: Column, size: int = 500) -> Column:
    """Sentences packed up to ``size`` characters."""
    return pack(
        sentences(c), F.length, lambda cur, w: cur + w + 1 <= size, lambda cur, w: cur + 1 + w
    )


def paragraph_chunks(c: Column) -> Column:
    return not_blank(F.split(c, "\\n\\n"))


def token_split(c: Column, max_tokens: int = 512) -> Column:
    """Sentences packed by the quarter-of-characters token estimate."""
    return pack(
        sentences(c),
        lambda p: F.greatest(F.lit(1).cast("long"), F.floor(F.length(p) / 4)),
        lambda cur, w: cur + w <= max_tokens,
        lambda cur, w: cur + w,
    )


def recursive_split(c: Column, size: int = 1000) -> Column:
    """Paragraphs; those longer than ``size`` as packed sentences (strictly shorter than ``size``)."""

    def long(p: Column) -> Column:
        return pack(
            sentences(p),
            F.length,
            lambda cur, w: cur + w < size,
            lambda cur, w: cur + 1 + w,
            lambda w: F.when(w < size, w + 1).otherwise(w),
        )

    return F.flatten(
        F.transform(paragraphs(c), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(long(p)))
    )


def recursive_chunks(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """The whole text, else its paragraphs, else packed sentences, else fixed windows."""
    short = lambda t, otherwise: F.when(F.length(t) <= size, F.array(t)).otherwise(otherwise(t))
    by_window = lambda s: short(s, lambda t: fixed(t, size, overlap))
    by_sentence = lambda p: short(
        p, lambda t: F.flatten(F.transform(sentence_chunks(t, size), by_window))
    )
    by_paragraph = lambda t: F.flatten(F.transform(paragraph_chunks(t), by_sentence))
    return F.when(F.length(c) <= size, fixed(c, size, overlap)).otherwise(by_paragraph(c))


def separator_chunks(c: Column, size: int = 800, overlap: int = 150) -> Column:
    """Separator hierarchy (blank line, line, sentence, blank, character) packed to ``size`` with overlap.

    Pieces keep their separator in front, so chunks are runs of the text. A chunk starts with the longest
    run of pieces of the previous one that stays within ``overlap`` and leaves room for the next piece.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")

    def cut(t: Column, level: int) -> Column:
        if level == len(SEPARATOR_CUTS):
            return F.transform(_starts(F.length(t), size), lambda i: F.substring(t, i + 1, F.lit(size)))
        return F.flatten(
            F.transform(
                F.filter(F.split(t, SEPARATOR_CUTS[level]), lambda p: p != ""),
                lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p, level + 1)),
            )
        )

    def assemble(ps: Column) -> Column:
        start = F.struct(
            F.array(F.lit(0).cast("long")).alias("ends"),
            F.array().cast("array<struct<lo:int,hi:int>>").alias("out"),
            F.lit(0).alias("lo"),
            F.lit(0).alias("i"),
        )

        def step(acc: Column, piece: Column) -> Column:
            w = F.length(piece).cast("long")
            done = F.element_at(acc["ends"], -1)
            length = done - F.element_at(acc["ends"], acc["lo"] + 1)
            full = length + w > size
            room = F.least(F.lit(overlap).cast("long"), size - w)
            back = F.size(F.filter(acc["ends"], lambda e: e < done - room))
            span = F.struct(acc["lo"].alias("lo"), acc["i"].alias("hi"))
            return F.struct(
                F.array_append(acc["ends"], done + w).alias("ends"),
                F.when(full, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
                F.when(full, F.greatest(acc["lo"], back)).otherwise(acc["lo"]).alias("lo"),
                (acc["i"] + 1).alias("i"),
            )

        spans = F.aggregate(
            ps,
            start,
            step,
            lambda a: F.array_append(a["out"], F.struct(a["lo"].alias("lo"), a["i"].alias("hi"))),
        )
        return F.transform(spans, lambda s: F.array_join(F.slice(ps, s["lo"] + 1, s["hi"] - s["lo"]), ""))

    return not_blank(let(cut(c, 0), assemble))


def merge_small(pieces: Column, minimum: int = 100) -> Column:
    """Join neighbours by a line break while the result stays below ``minimum`` characters."""
    return F.transform(
        pack(
            pieces,
            F.length,
            lambda cur, w: cur + w < minimum,
            lambda cur, w: cur + 1 + w,
            lambda w: F.when(w < minimum, w + 1).otherwise(w),
            "\n",
        ),
        strip,
    )


def merge_small_chunks(pieces: Column, minimum: int = 120) -> Column:
    """Join the next chunk as long as the current one is below ``minimum`` characters."""
    return pack(pieces, F.length, lambda cur, w: cur < minimum, lambda cur, w: cur + 1 + w, separator="\n")


def heading_chunks(c: Column) -> Column:
    return not_blank(F.split(c, HEADING_CUT))


def code_chunks(c: Column) -> Column:
    return not_blank(F.split(c, CODE_CUT))


def split_yaml(c: Column) -> Column:
    return not_blank(F.split(c, YAML_CUT))


def split_sql(c: Column) -> Column:
    return not_blank(F.split(c, SQL_CUT))


def split_logs(c: Column) -> Column:
    return not_blank(F.split(c, LOG_CUT))


def split_code(c: Column) -> Column:
    return split_characters(c, 1500, 150)


def _quote(separator: str) -> str:
    return "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_by_separator(c: Column, separator: str = "\n\n", keep: bool = False) -> Column:
    """Pieces between literal separators; with ``keep`` each piece keeps the one that follows it."""
    if keep:
        return F.filter(F.split(c, f"(?<={_quote(separator)})"), lambda p: strip(p) != "")
    return not_blank(F.split(c, _quote(separator)))


def split_html(c: Column) -> Column:
    """Text of headings, paragraphs, list items, quotes and code blocks in document order."""
    # The elements that carry text.
    blocks = "(?is)<(h[1-4]|p|li|pre|code|blockquote)\\b[^>]*>(.*?)</\\1\\s*>"
    inner = F.regexp_extract_all(c, F.lit(blocks), 2)
    return F.filter(
        F.transform(inner, lambda t: strip(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "(?U)\\s+", " "))),
        lambda t: t != "",
    )


def split_csv(c: Column, rows: int = 100) -> Column:
    """Blocks of ``rows`` lines, each under the header line."""
    from lorespan.functions.text import lines

    return let(
        lines(c),
        lambda ls: F.transform(
            _starts(F.size(ls) - 1, rows),
            lambda i: F.array_join(F.concat(F.slice(ls, 1, 1), F.slice(ls, i + 2, rows)), "\n"),
        ),
    )


def split_json(c: Column) -> Column:
    """Object: one ``key: value`` piece per member; array: one piece per item; else the value."""
    as_map = F.from_json(c, "map<string,string>")
    as_list = F.from_json(c, "array<string>")
    head = F.substring(strip(c), 1, 1)
    members = F.transform(F.map_entries(as_map), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(head == "{", members).when(head == "[", as_list).otherwise(F.array(c))


def split_file(c: Column, extension: Column) -> Column:
    """The splitter that belongs to the file's extension."""
    return (
        F.when(extension == "md", heading_chunks(c))
        .when(extension == "html", split_html(c))
        .when(extension == "json", split_json(c))
        .when(extension == "csv", split_csv(c))
        .when(extension.isin("yaml", "yml"), split_yaml(c))
        .when(extension == "sql", split_sql(c))
        .when(extension == "py", code_chunks(c))
        .otherwise(recursive_split(c))
    )
