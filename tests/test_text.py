"""Text, cleaning and chunking expressions on literal rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lorespan.functions import chunking as k, cleaning as c, text as t, unicode as u
from lorespan.operators import chunk, clean, structure

X = F.col("x")


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "x string").select(expr.alias("y")).first()["y"]


CASES = [
    ("words", t.words(X), " a  b\tc\nd ", ["a", "b", "c", "d"]),
    ("words of nothing", t.words(X), "", []),
    ("lines", t.lines(X), "a\r\nb\rc\n", ["a", "b", "c"]),
    ("lines of nothing", t.lines(X), "", []),
    ("sentences", t.sentences(X), "One. Two!  Three? four", ["One.", "Two!", "Three?", "four"]),
    ("sentence count", t.sentence_count(X), "a. b!! ? c", 3),
    ("paragraphs", t.paragraphs(X), "a\n \nb\n\n\nc", ["a", "b", "c"]),
    ("tokens", t.tokens(X), "It's über-cool, No_1!", ["its", "übercool", "no_1"]),
    ("chars4", t.token_estimate(X, "chars4"), "", 1),
    ("chars4 or zero", t.token_estimate(X, "chars4_or_zero"), "", 0),
    ("chars4 floor", t.token_estimate(X, "chars4_floor"), "abcdefg", 1),
    ("words13", t.token_estimate(X, "words13"), "a b c d e", 6),
    ("preview", t.preview(X, 3), "abcd", "abc..."),
    ("preview short", t.preview(X, 4), "abcd", "abcd"),
    ("control", c.remove_control_characters(X), "a\x00b\tc\nd\x7f", "ab\tc\nd"),
    ("line ends", c.normalize_line_endings(X), "a\r\nb\rc", "a\nb\nc"),
    ("blank lines", c.remove_empty_lines(X), "a\n \n\nb", "a\nb"),
    ("newlines", c.collapse_newlines(X), "a\n\n\n\nb", "a\n\nb"),
    ("tags", c.remove_html_tags(X), "<p>a</p>b", " a b"),
    ("links", c.remove_urls(X), "see HTTPS://www.a.org/b?c=1<br> x", "see <br> x"),
    ("www", c.normalize_urls(X), "see www.a.org and http://b", "see <URL> and <URL>"),
    ("mail", c.normalize_emails(X), "to a.b@c.de, now", "to <EMAIL>, now"),
    ("no mail after a letter", c.normalize_emails(X), "éa@c.de", "éa@c.de"),
    ("phone", c.normalize_phone_numbers(X), "call +1 555-123-4567 now", "call <PHONE> now"),
    ("number", c.normalize_numbers(X), "3.14 and x2 and 7", "<NUMBER> and x2 and <NUMBER>"),
    ("quotes", c.normalize_quotes(X), "“a” ‘b’ „c‟", "\"a\" 'b' \"c\""),
    ("dashes", c.normalize_dashes(X), "a–b—c", "a-b-c"),
    ("punctuation", c.normalize_punctuation(X), "a!! b?? c.....", "a! b? c..."),
    ("squeezed", c.squeeze_punctuation(X), "a!? b,, c....", "a! b, c..."),
    ("symbols", c.normalize_symbols(X), "• a → b ⇒ c", "- a -> b => c"),
    ("ocr", c.clean_ocr_noise(X), "of\u00adﬁce a  b  c", "office a b c"),
    ("zero width", c.remove_blank_characters(X), "a\u200bb\ufeffc", "abc"),
    ("page numbers", c.remove_page_numbers(X), "a\n Page 3 \n12\nb 3", "a\nb 3"),
    ("hyphenation", c.fix_hyphenation(X), "wor-\nd", "word"),
    ("merge", c.merge_paragraphs(X), "a\nb\n\nc", "a b\n\nc"),
    ("watermark", c.remove_watermarks(X), "x Draft y Do Not Distribute", "x  y "),
    ("table", c.remove_table_artifacts(X), "a --- b ||| c", "a   b | c"),
    ("emoji", c.remove_emojis(X, "<EMOJI>"), "a \U0001f600\U0001f680 b", "a <EMOJI> b"),
    ("markdown", c.remove_markdown(X), "# H\n**b** [t](u) `c`", " H\n b     "),
    ("paragraph form", c.normalize_paragraphs(X), " a\nb \n\n\n c  d", "a b\n\nc d"),
    ("sentence form", c.normalize_sentences(X), "a , b .C  d", "a, b. C d"),
    ("nfkc", u.normalize_unicode(X), "ﬁ①", "fi1"),
    ("entities", u.decode_html_entities(X), "&lt;a&gt; &#233;&nbsp;", "<a> é\xa0"),
    ("accents", u.remove_accents(X), "éñü", "enu"),
    ("stop words", c.remove_stopwords(X, ["the", "of"]), "The end OF it", "end it"),
    ("rules", c.apply_rules(X, [("A+", "x", "i"), ("b", "")]), "aaAb", "x"),
    ("first lines", c.remove_duplicate_lines(X), "A\n\na\nb\n\nB ", "A\n\nb\n"),
    ("first lines exact", c.remove_duplicate_lines(X, True, True), "A\n\na\nb\nA", "A\na\nb"),
    ("repeated", c.repeated_lines(X, 2), "h\na\nH\nb\nh", ["h"]),
    ("headers", c.remove_repeated_lines(X), "h\na\nH\nb\nh", "a\nb"),
    ("headers below the number", c.remove_repeated_lines(X), "h\na\nh\n", "h\na\nh\n"),
    ("headers short text", c.remove_repeated_lines(X, 3, True, 6), "h\nh\nh", "h\nh\nh"),
    ("all lines repeated", c.remove_repeated_lines(X), "h\nh\nh", ""),
    ("basic", clean.clean_basic(X), " a \r\n\r\n\r\n b\t c &amp; d\x07 ", "a\nb c & d"),
    ("basic with paragraphs", clean.clean_basic(X, remove_empty_lines=False), "a\n\n\n\nb", "a\n\nb"),
    ("characters", k.split_characters(X, 4, 1), "abcdefgh", ["abcd", "defg", "gh"]),
    ("words overlap", k.split_words(X, 3, 1), "a b c d e", ["a b c", "c d e", "e"]),
    ("window fits", k.token_windows(X, 5, 2), "a  b", ["a  b"]),
    ("separator", k.split_by_separator(X, "."), "a. b..", ["a", "b"]),
    ("separator kept", k.split_by_separator(X, ".", True), "a. b", ["a.", " b"]),
    ("sentence chunks", k.sentence_chunks(X, 10), "Aa bb. Cc. Dd ee ff gg. H.", ["Aa bb. Cc.", "Dd ee ff gg.", "H."]),
    ("long first sentence", k.sentence_chunks(X, 4), "Aaaaaaa. B.", ["Aaaaaaa.", "B."]),
    ("token split", k.token_split(X, 3), "Aaaa bbb. Cccc. Dddd.", ["Aaaa bbb. Cccc.", "Dddd."]),
    ("merge small", k.merge_small(F.split(X, "\\|"), 5), "a|b|cccc|d", ["a\nb", "cccc", "d"]),
    ("merge chunks", k.merge_small_chunks(F.split(X, "\\|"), 3), "a|b|cccc|d", ["a\nb", "cccc", "d"]),
    ("headings", k.heading_chunks(X), "x\n# A\ny\n## B\nz", ["x", "# A\ny", "## B\nz"]),
    ("code", k.code_chunks(X), "import a\ndef f():\n  pass\nclass B:\n  x", ["import a", "def f():\n  pass", "class B:\n  x"]),
    ("yaml", k.split_yaml(X), "a: 1\n---\nb: 2", ["a: 1", "b: 2"]),
    ("sql", k.split_sql(X), "select 1;\nselect 2", ["select 1", "select 2"]),
    ("logs", k.split_logs(X), "2024-01-01 a\n  b\n2024-01-02 c", ["2024-01-01 a\n  b", "2024-01-02 c"]),
    ("csv", k.split_csv(X, 2), "h\n1\n2\n3", ["h\n1\n2", "h\n3"]),
    ("csv of nothing", k.split_csv(X, 2), "", []),
    ("json object", k.split_json(X), '{"a": 1, "b": "x"}', ["a: 1", "b: x"]),
    ("json array", k.split_json(X), '["x", "y"]', ["x", "y"]),
    ("html", k.split_html(X), "<h1>A <b>b</b></h1><p></p><ul><li>c</li></ul>", ["A b", "c"]),
    ("overlap", chunk.with_overlap(F.split(X, "\\|"), 2), "a b c|d|e", ["a b c", "b c d", "d e"]),
    ("tables", structure.table_texts(X), "a|b\nc|d\nx\ne|f", ["a|b\nc|d", "e|f"]),
    ("no tables", structure.table_texts(X), "", []),
    ("plain", structure.plain_text(X), "# T\n- **a** [b](c)", "T\na b"),
]


@pytest.mark.parametrize("name,expr,text,want", [(n, i, x, w) for i, (n, _, x, w) in enumerate(CASES)], ids=[c_[0] for c_ in CASES])
def test_case(spark, name, expr, text, want):
    assert one(spark, text, CASES[expr][1]) == want


@pytest.mark.parametrize("length", [1, 49, 50, 450, 451, 500, 501, 950, 951, 1400])
def test_fixed_windows_stop_at_the_end(spark, length):
    spans = one(spark, "x" * length, k.fixed_spans(X, 500, 50))
    assert len(spans) == math.ceil(max(length - 50, 1) / 450)
    assert spans[-1]["end_char"] == length and [s["start_char"] for s in spans] == [450 * i for i in range(len(spans))]


def test_recursive_chunks_fall_back_level_by_level(spark):
    text = "short one.\n\n" + "Aaaa bbb. " * 5 + "\n\n" + "x" * 45
    got = one(spark, text, k.recursive_chunks(X, 20, 5))
    assert got[0] == "short one." and got[1:4] == ["Aaaa bbb. Aaaa bbb.", "Aaaa bbb. Aaaa bbb.", "Aaaa bbb."]
    assert got[4:] == ["x" * 20, "x" * 20, "x" * 15]


def test_separator_chunks_are_runs_of_the_text(spark):
    text = "One two. Three four.\nFive six seven\n\neight " + "z" * 70
    got = one(spark, text, k.separator_chunks(X, 30, 10))
    assert all(len(g) <= 30 and g in text for g in got)
    without = one(spark, text, k.separator_chunks(X, 30, 0))
    assert "".join(without).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")


def test_zero_overlap_windows_rebuild_the_text(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    spans = k.fixed_spans(X, 100, 0)
    bad = docs.withColumnRenamed("text", "x").where(
        F.replace(F.array_join(F.transform(spans, lambda s: s["text"]), ""), F.lit(" "), F.lit(""))
        != F.replace(X, F.lit(" "), F.lit(""))
    )
    # Windows are stripped, so only white space at their ends may be missing.
    assert bad.where(~X.contains("\n")).count() == 0


def test_merged_spans_keep_offsets(spark):
    spans = chunk.merge_small_spans(chunk._with_offsets(F.split(X, "\\|"), 1), 3)
    got = one(spark, "a|b|cccc|d", spans)
    assert [(s["text"], s["start_char"], s["end_char"]) for s in got] == [("a\nb", 0, 3), ("cccc", 4, 8), ("d", 9, 10)]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="unknown strategy"):
        chunk.chunk_spans("none", X)


def test_language_needs_a_stop_word(spark):
    df = spark.createDataFrame([(1, "the end of it"), (2, "zzz"), (3, "le chat et la souris")], "doc_id int, text string")
    got = {r["doc_id"]: r["detected"] for r in clean.detect_language(df).collect()}
    assert got == {1: "en", 2: "unknown", 3: "fr"}


def test_sections(spark):
    df = spark.createDataFrame([(1, "# A\nx\n## B\n\ny"), (2, "plain")], "doc_id int, text string")
    got = [(r["doc_id"], r["heading"], r["level"], r["content"]) for r in structure.sections(df).orderBy("doc_id", "n").collect()]
    assert got == [(1, "A", 1, "x"), (1, "B", 2, "y"), (2, None, 0, "plain")]
