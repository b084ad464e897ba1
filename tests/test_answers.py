"""Faithfulness, hallucination, relevance, latency and benchmark rules by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorespan.operators import benchmark as b, faithfulness as fa, hallucination as ha, latency as la, relevance as rel

ROWS = [
    (1, "The red cat sat on the mat. Dogs never eat any green apples today. Short one.", ["The red cat sat on the old mat.", "Nothing else."]),
    (2, "", ["something here"]),
    (3, "We paid 12.5 to New York City on 2024-01-02 without fees.", ["we paid 12.5", "on 3 May 2020 in Old Town"]),
]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(ROWS, "id int, answer string, context array<string>")


def test_claims(answers):
    got = fa.verify_claims(answers, ["id"]).where("id = 1").orderBy("claim_index").collect()
    assert [(x["claim"], x["supported"], x["score"]) for x in got] == [
        ("the red cat sat on the mat.", True, 1.0),
        ("dogs never eat any green apples today.", False, 0.0),
    ]
    assert got[0]["evidence"] == "the red cat sat on the old mat." and got[1]["evidence"] == ""


def test_faithfulness(answers):
    got = {x["id"]: x for x in fa.evaluate(answers, ["id"]).collect()}
    one = got[1]
    assert (one["faithfulness"], one["groundedness"], one["evidence_score"]) == (0.5, 0.5, 0.5)
    assert (one["supported_claims"], one["unsupported_claims"], one["total_claims"]) == (1, 1, 2)
    assert one["completeness"] == round(6 / 9, 4)
    two = got[2]
    assert (two["faithfulness"], two["total_claims"], two["completeness"]) == (0.0, 0, 0.0)


def test_hallucination(answers):
    got = {x["id"]: x for x in ha.evaluate(ha.detect(answers, ["id"]), ["id"]).collect()}
    three = got[3]
    assert (three["unsupported_claims"], three["entity_errors"], three["date_errors"]) == (1, 1, 1)
    # 2024, 01 and 02 are numbers too, and none of them is in the context.
    assert three["numeric_errors"] == 3 and three["numeric_coverage"] == 0.25 and three["score"] == 0.0
    two = got[2]
    assert (two["claims"], two["score"], two["factual_consistency"], two["evidence_coverage"]) == (0, 1.0, 1.0, 1.0)


def test_contradiction_needs_the_claim_in_the_context(spark):
    rows = [(1, "birds fly high.", ["birds fly high. but not today."]), (2, "birds do not fly.", ["birds do not fly."])]
    got = ha.detect(spark.createDataFrame(rows, "id int, answer string, context array<string>"), ["id"]).orderBy("id").collect()
    assert [len(x["contradictions"]) for x in got] == [1, 0]


def test_relevance(spark):
    pairs = spark.createDataFrame([(1, 1, "red apple", "a red apple"), (1, 2, "red apple", "red sky"), (2, 3, "", "x")], "query_id int, vec_id int, query_text string, text string")
    got = {x["vec_id"]: x for x in rel.score_pairs(pairs).collect()}
    assert [got[i]["relevance"] for i in (1, 2, 3)] == [0.4, 0.2, 0.0] and not got[1]["relevant"]
    with_vectors = rel.score_pairs(pairs, semantic=F.lit(1.0))
    assert {x["vec_id"]: x["relevant"] for x in with_vectors.collect()} == {1: True, 2: True, 3: False}
    assert [x["vec_id"] for x in rel.rank_documents(with_vectors, ["query_id"], "vec_id", 1).orderBy("query_id").collect()] == [1, 3]


@pytest.mark.parametrize("ms,want", [(100.0, "A+"), (100.1, "A"), (500.0, "B"), (1000.0, "C"), (2000.0, "D"), (2000.1, "F")])
def test_grades(spark, ms, want):
    assert spark.range(1).select(la.grade(F.lit(ms)).alias("g")).first()["g"] == want


def test_latency(spark):
    df = spark.createDataFrame([(1, 10.0, 30.0), (2, None, None)], "id int, a double, b double")
    got = {x["id"]: x for x in la.evaluate(df, ["id"], ("a", "b"), F.lit(2), F.lit(8)).collect()}
    one, two = got[1], got[2]
    assert (one["total_latency"], one["queries_per_second"], one["tokens_per_second"]) == (40.0, 50.0, 200.0)
    assert (one["a_percent"], one["b_percent"], one["slowest_stage"], one["fastest_stage"]) == (25.0, 75.0, "b", "a")
    assert (two["total_latency"], two["queries_per_second"], two["slowest_stage"]) == (0.0, 0.0, "a")


def test_benchmark(spark):
    a = spark.createDataFrame([("m", 1, 0.9, 100.0), ("m", 2, 0.5, 300.0), ("n", 1, 0.8, 50.0)], "system string, query_id int, retrieval_score double, latency_ms double")
    c = spark.createDataFrame([("m", 1, 0.7), ("n", 1, 1.0)], "system string, query_id int, hallucination_score double")
    results = b.overall(b.join_scores([a, c]))
    got = {(x["system"], x["query_id"]): x["overall_score"] for x in results.collect()}
    assert got == {("m", 1): 0.8, ("m", 2): 0.5, ("n", 1): 0.9}
    ranked = b.ranking(b.statistics(results, ["system"])).orderBy("position").collect()
    assert [(x["system"], x["position"], x["success_rate"]) for x in ranked] == [("n", 1, 1.0), ("m", 2, 0.5)]
    runtime = b.runtime_statistics(results, ["system"]).where("system = 'm'").first()
    assert (runtime["total_runtime_seconds"], runtime["throughput_qps"]) == (0.4, 5.0)
    assert not b.validate_dataset(spark.createDataFrame([("",)], "query string")).first()["valid"]
    assert not b.validate_dataset(spark.createDataFrame([], "query string")).first()["valid"]
