"""Rows of larger tables on which a query and its SQL once differed."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lorespan.plans import load
from tests.compare import TABLES, compare, duck

ENTRIES = load()


def _root(tmp_path, root, **files):
    for t in TABLES:
        if t not in files:
            os.symlink(f"{root}/{t}.parquet", tmp_path / f"{t}.parquet")
    for t, df in files.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    con_root = str(tmp_path / "flat")
    os.mkdir(con_root)
    for t in TABLES:
        path = tmp_path / f"{t}.parquet"
        source = next(path.glob("part-*")) if t in files else path
        os.symlink(source, f"{con_root}/{t}.parquet")
    return con_root


def _same(spark, at, *names):
    con = duck(at)
    for name in names:
        ok, note = compare(spark, con, name, ENTRIES[name], at)
        assert ok, (name, note)


def test_latency_without_time_and_on_the_edge_of_rounding(spark, root, tmp_path):
    values = [0.0, 28.5, 35.0877192982456, 8000.0, 0.01, 99.99, 0.1, 0.2, 0.3]
    rows = ", ".join(
        f"({i}L, timestamp_ntz'2024-01-02 03:04:05', {i // 2}L, '{'click' if i % 2 else 'view'}', {v}D, '{{}}')" for i, v in enumerate(values)
    )
    events = spark.sql(f"select * from values {rows} as t(event_id, ts, user_id, event_type, value, props)")
    zero = events.where("event_id = 0").selectExpr("99L as event_id", "ts", "99L as user_id", "event_type", "0D as value", "props")
    _same(spark, _root(tmp_path, root, events=events.unionByName(zero)), "latency_requests", "latency_statistics")


def test_character_references_of_pages(spark, root, tmp_path):
    texts = [
        "cut &amp", "&ampx &ltb &notit; &notin; &copy2 &nosuch; &", "&#65;&#x41 &#0; &#128; &#x1F600; &#xD800; &#1; &#99999999999999999999;",
        "a&nbsp;b   c", "&amp;lt; &lt;b&gt;", "<template>x</template>y<noscript>z</noscript>", "", "&Agrave;&eacute &bigstar;", "&#x; &#; &#xZ",
    ]
    pages = spark.createDataFrame([(i, "u", x) for i, x in enumerate([*texts, None])], "page_id long, url string, html string")
    _same(spark, _root(tmp_path, root, pages=pages), "html_text")


@pytest.mark.parametrize(
    "names",
    [("search_text", "retrieve", "prompt_contexts", "context_sources", "export_search_results"), ("document_relevance", "compare_retrievers", "relevance_statistics"), ("relevance_evaluation", "relevance_distribution", "relevance_query_summary")],
)
def test_texts_without_a_word_score_nothing(spark, root, tmp_path, names):
    docs = spark.read.parquet(f"{root}/documents.parquet").where("doc_id < 20")
    blank = docs.where("doc_id < 3").selectExpr("doc_id + 1000 as doc_id", "'... --- !!!' as text", "lang", "source", "11 as n_chars")
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    blank = blank.select(*[blank[c].cast(kinds[c]).alias(c) for c in docs.columns])
    _same(spark, _root(tmp_path, root, documents=docs.unionByName(blank)), *names)


@pytest.mark.parametrize("n", [2, 4])
def test_relevance_means_that_lie_half_way(spark, root, tmp_path, n):
    """Two or four hits a query: many means lie half way between two values of four places."""
    docs = spark.read.parquet(f"{root}/documents.parquet").where(f"doc_id < {n}")
    docs = docs.selectExpr("doc_id", "array_join(slice(split(text, ' '), 1, 150), ' ') as text", "lang", "source", "n_chars")
    _same(spark, _root(tmp_path, root, documents=docs), "relevance_evaluation", "relevance_query_summary", "compare_retrievers", "relevance_statistics")


def test_relevance_of_texts_with_wide_white_space(spark, root, tmp_path):
    docs = spark.read.parquet(f"{root}/documents.parquet").where("doc_id < 12")
    spaces = "\x0b\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    wide = "array_join(transform(split(text, ' '), (w, i) -> concat(w, substr(s, cast(i % 10 + 1 as int), 1))), '')"
    docs = docs.withColumn("s", F.lit(spaces)).selectExpr("doc_id", f"{wide} as text", "lang", "source", "n_chars")
    _same(spark, _root(tmp_path, root, documents=docs), "relevance_evaluation", "relevance_query_summary", "document_relevance")


def test_unit_vectors_of_odd_rows_and_the_sign_of_zero(spark, root, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [-1e-8, 1.0, -0.0], 3), (1, [0.0, 0.0], 3), (2, [1.0, 2.0], None), (3, [1.0, 2.0], -1), (4, [1.0, None, 2.0], 7),
        (5, [nan, 1.0], 0), (6, [nan, 1.0], 2), (7, None, 2), (8, None, 0), (9, [], 2), (10, [None, -1.0], 0), (11, [inf, -1.0], 5),
        (12, [0.1234565, -0.2469135, (1 - 0.1234565**2 - 0.2469135**2) ** 0.5], 1), (13, [None, None], 4),
    ]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    at = _root(tmp_path, root, embeddings=e)
    shown = lambda unit: None if unit is None else [repr(x) for x in unit]
    got = {x["vec_id"]: shown(x["unit"]) for x in ENTRIES["normalize_vectors"].run(spark, at).collect()}
    assert got == {i: shown(unit) for i, unit in duck(at).execute(ENTRIES["normalize_vectors"].sql).fetchall()}
    assert got[0][0] == "-0.0" and got[1] == ["None", "None"] and got[5] == ["0.0", "0.0"] and not {2, 3} & set(got)


@pytest.mark.parametrize("name", ["remove_duplicate_lines", "remove_duplicate_lines_exact"])
def test_texts_without_a_line(spark, root, tmp_path, name):
    texts = ["", None, "\n", " \n\n\t\n", "a\nA \n\na\nb"]
    docs = spark.createDataFrame(
        [(i, x, "en", "s", 0) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int"
    )
    at = _root(tmp_path, root, documents=docs)
    _same(spark, at, name)
    assert sorted(x["doc_id"] for x in ENTRIES[name].run(spark, at).collect()) == [2, 3, 4]
