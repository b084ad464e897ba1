"""One key holds a third of all rows: results equal plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorespan.operators import conversation as conv, dedup, sessions as se, skew, usage as us
from lorespan.sources import export as ex


@pytest.fixture(scope="module")
def chats():
    """Conversation 0 has 3000 of 9000 turns, with gaps in the turn numbers and some empty texts."""
    rnd = random.Random(1)
    rows = [(0, t * rnd.choice([1]) + t, rnd.choice(["user", "assistant"]), "x" * rnd.choice([0, 3, 40, 400])) for t in range(3000)]
    rows += [(1 + i // 20, i % 20, "user", "y" * rnd.randrange(300)) for i in range(6000)]
    return rows


@pytest.fixture(scope="module")
def messages(spark, chats):
    return spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").repartition(8).cache()


def tokens(text):
    return max(1, len(text) // 4) if text else 0


def by_conversation(chats):
    out = {}
    for c, t, r, x in sorted(chats):
        out.setdefault(c, []).append((t, r, x))
    return out


def test_context_window(messages, chats):
    want = set()
    for c, rows in by_conversation(chats).items():
        left = 500
        for t, _, x in reversed(rows):
            left -= tokens(x)
            if left < 0:
                break
            want.add((c, t))
    assert {(r["conv_id"], r["turn"]) for r in conv.context_window(messages, 500).collect()} == want


def test_recent_and_summary(messages, chats):
    want = {c: [t for t, _, _ in rows[-7:]] for c, rows in by_conversation(chats).items()}
    got = {}
    for r in conv.recent_messages(messages, 7).orderBy("turn").collect():
        got.setdefault(r["conv_id"], []).append(r["turn"])
    assert got == want
    cut = lambda x: x if len(x) <= 120 else x[:120] + "..."
    summary = {c: "\n".join(f"{r}: {cut(x)}" for _, r, x in rows[-5:]) for c, rows in by_conversation(chats).items()}
    assert {r["conv_id"]: r["summary"] for r in conv.summarize(messages).collect()} == summary


def test_nested_records_are_flat_and_whole(messages, chats):
    parents = messages.select("conv_id").distinct()
    got = ex.nested(parents, messages, "conv_id", "turn").collect()
    joined = {}
    for r in got:
        joined.setdefault(r["conv_id"], []).append((r["message"]["turn"], r["message"]["role"], r["message"]["text"]))
    assert joined == by_conversation(chats)


def test_far_pages_and_rows(spark):
    from lorespan.operators import predicates

    df = spark.range(100_000).select(F.col("id"), F.concat(F.lit("key"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("s"))
    for order in (["id"], ["s"]):
        assert predicates.row_at(df, order, 77_777).first()["id"] == 77_777
        assert sorted(r["id"] for r in predicates.page(df, order, 3_001, 25).collect()) == list(range(75_000, 75_025))
        plan = predicates.page(df, order, 3_001, 25)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_empty_turns_do_not_fill_a_prompt(spark):
    from lorespan.operators import conversation

    turns = spark.range(5_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("").alias("text"))
    assert len(conversation.prompt_memory(turns, 100).first()["messages"]) == 100


def test_too_many_queries_are_refused_before_they_are_collected(spark):
    from lorespan.operators import retrieve

    wide = spark.range(300).select(F.col("id").alias("query_id"), F.array_repeat(F.lit(1.0), 40_000).alias("embedding"))
    corpus = spark.createDataFrame([(1, [1.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too many to broadcast"):
        retrieve.search(wide, corpus)


def test_duplicates_keep_the_first(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = {}
    for i, x in rows:
        want.setdefault(x, i)
    assert {r["text"]: r["doc_id"] for r in dedup.keep_first_text(df, ["doc_id"]).collect()} == want


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(6000):
        user = 0 if i % 3 == 0 else rnd.randrange(1, 40)
        rows.append((i, start + dt.timedelta(seconds=rnd.randrange(20 * 86400)), user))
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").repartition(8).cache()


def test_sessions(events):
    rows, df = events
    want = set()
    for user in {u for _, _, u in rows}:
        times = sorted(t for _, t, u in rows if u == user)
        start, last, n = times[0], times[0], 0
        for t in times:
            if t > last + dt.timedelta(minutes=30):
                want.add((user, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        want.add((user, start, last, n))
    got = se.session_table(se.sessionize(df, "30 minutes")).collect()
    assert {(r["user_id"], r["created_at"], r["last_activity"], r["events"]) for r in got} == want
    assert len(got) == len(want)


def test_merged_periods_equal_the_whole(events):
    _, df = events
    u = df.select(
        "user_id", F.col("ts").alias("created_at"), (F.col("event_id") % 7).cast("double").alias("duration_ms"),
        F.lit("custom").alias("provider"), *[F.col("event_id").alias(k) for k in us.TOKEN_KINDS],
    )
    parts = [us.period_counters(u, p).drop("period") for p in ("daily",)]
    merged, whole = us.merge_counters(*parts).first(), us.totals(u).first()
    assert merged["requests"] == whole["total_chats"] and merged["tokens"] == whole["total_tokens"]
    assert merged["average_latency"] == pytest.approx(whole["average_latency"], abs=0.01)
