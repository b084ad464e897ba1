"""What the physical plans must and must not hold."""

from __future__ import annotations

import pytest

from lorespan.plans import load

ENTRIES = load()
# These run jobs while they are built: they write, stream or count first.
ACTIONS = {n for n in ENTRIES if n.startswith(("stream_", "export_"))} | {
    "save_embeddings", "metric_exposition", "text_files", "benchmark_files",
}
# The only queries whose rows pass through Python.
PYTHON = {
    "clean_normalize_unicode", "clean_decode_html_entities", "clean_remove_accents", "clean_basic", "clean_documents",
    "clean_documents_all_flags", "cleaning_report", "preprocess_documents", "html_text", "embed_documents",
}
SEARCH = ("search_", "mmr_", "similarity_pairs", "precision_at_5", "format_results", "retrieve", "prompt_contexts",
          "context_sources", "hybrid_", "document_relevance", "relevance_", "compare_retrievers", "ranking_metrics",
          "mean_ranking_metrics")


def plan(spark, root, name: str) -> str:
    return ENTRIES[name].run(spark, root)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ENTRIES) - ACTIONS))
def test_no_cross_join_and_python_only_where_declared(spark, root, name):
    text = plan(spark, root, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in PYTHON and not name.startswith(SEARCH):
        assert "ArrowEvalPython" not in text and "InArrow" not in text and "InPandas" not in text


@pytest.mark.parametrize(
    "name,pushed,columns",
    [
        ("search_by_metadata", ["EqualTo(lang,de)", "EqualTo(source,src2)"], "doc_id:bigint,lang:string,source:string"),
        ("search_with_filter", ["EqualTo(label,3)"], "vec_id:bigint,embedding:array<float>,label:int"),
        ("filter_rows", ["EqualTo(o_orderpriority,2-HIGH)"], "o_orderkey:bigint,o_totalprice:double,o_orderpriority:string"),
        ("search_period", ["GreaterThanOrEqual(ts,", "LessThan(ts,"], "event_id:bigint,ts:timestamp"),
        ("daily_report", ["GreaterThanOrEqual(ts,", "LessThan(ts,"], "ts:timestamp,props:string"),
        ("suspicious_activity", ["EqualTo(event_type,error)"], "ts:timestamp,user_id:bigint,event_type:string"),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, root, name, pushed, columns):
    text = plan(spark, root, name)
    assert all(p in text for p in pushed), text
    assert f"ReadSchema: struct<{columns}>" in text, text


@pytest.mark.parametrize("name", ["recent_messages", "login_history", "remove_duplicate_chunks", "search_cosine", "retrieve"])
def test_top_rows_are_limited_before_the_shuffle(spark, root, name):
    assert "Partial" in "".join(x for x in plan(spark, root, name).splitlines() if "WindowGroupLimit" in x)


def test_the_encoder_runs_once_per_side(spark, root):
    assert plan(spark, root, "retrieve").count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["clean_documents", "chunk_recursive", "remove_duplicate_lines", "faithfulness", "chunk_metadata"])
def test_row_local_text_work_is_not_shuffled(spark, root, name):
    text = plan(spark, root, name)
    hashed = [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "doc_id" in x]
    assert not hashed, hashed


def test_tables_are_dealt_out_only_on_request(spark, root):
    from lorespan.sources.tables import READ_PARTITIONS, table

    plan = lambda: table(spark, root, "documents")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(READ_PARTITIONS)
    assert "Exchange" in plan()
    try:
        spark.conf.unset(READ_PARTITIONS)
        assert "Exchange" not in plan()
    finally:
        spark.conf.set(READ_PARTITIONS, before)


def test_rank_correlation_plans_do_not_grow_with_the_columns(spark, root):
    from lorespan.operators.profile import correlation

    df = spark.read.parquet(f"{root}/lineitem.parquet")
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scans = [
        correlation(df, "spearman", columns[:n], pairwise)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
        for n in (3, 8)
        for pairwise in (False, True)
    ]
    assert len(set(scans)) == 1 and scans[0] <= 6
