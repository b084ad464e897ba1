"""Conversations and memories: flat messages ``(conv_id, turn, role, text)``, one row per turn.

``turn`` is unique within a conversation. Running sums and positions go through ``skew``, so a conversation of any
length is spread over many tasks; the last messages are limited on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.skew import first_rows, prefix_sums, side_by_side, width_bucket

CONV, TURN = "conv_id", "turn"


def _tokens(text: str = "text") -> Column:
    return t.token_estimate(F.col(text), "chars4_or_zero")


def recent_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` messages of every conversation."""
    return first_rows(messages, [CONV], [F.desc(TURN)], n, "_rn").drop("_rn")


def context_window(messages: DataFrame, max_tokens: int = 4000, least: int = 0) -> DataFrame:
    """The newest messages whose token estimates fit into the budget; the first that does not fit ends the window.

    Estimates are not negative, so "stop at the first overflow" is "suffix sum within the budget". Every message is
    charged ``least`` tokens at least.
    """
    cost = F.greatest(_tokens(), F.lit(least))
    summed = prefix_sums(messages, [CONV], [TURN], width_bucket(TURN), {"_before": cost}, {"_all": "_before"})
    suffix = F.col("_all") - F.col("_before") + cost
    return (
        summed.withColumn("tokens", _tokens()).withColumn("window_tokens", suffix)
        .where(F.col("window_tokens") <= max_tokens)
        .drop("_before", "_all")
    )


def conversation_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy(CONV).agg(F.sum(_tokens()).alias("tokens"))


def summarize(messages: DataFrame, n: int = 5, characters: int = 120) -> DataFrame:
    """The last ``n`` messages as ``role: text`` lines, long texts cut."""
    line = F.concat(F.col("role"), F.lit(": "), t.preview(F.col("text"), characters))
    lines = F.sort_array(F.collect_list(F.struct(TURN, line.alias("line"))))
    return recent_messages(messages, n).groupBy(CONV).agg(
        F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("summary")
    )


def prompt_memory(messages: DataFrame, max_tokens: int = 3000) -> DataFrame:
    """Per conversation: the messages of the window, the summary, the tokens of all messages.

    An empty message is charged one token, so the budget also bounds the number of messages held.
    """
    window = context_window(messages, max_tokens, least=1)
    held = F.sort_array(F.collect_list(F.struct(TURN, "role", "text")))
    kept = window.groupBy(CONV).agg(
        F.transform(held, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")
    )
    empty = F.array().cast(kept.schema["messages"].dataType)
    return (
        conversation_tokens(messages)
        .join(summarize(messages), CONV)
        .join(kept, CONV, "left")
        .select(CONV, F.coalesce("messages", empty).alias("messages"), "summary", F.col("tokens").alias("token_count"))
    )


def prune_history(messages: DataFrame, keep_last: int = 100) -> DataFrame:
    return recent_messages(messages, keep_last)


def get_messages(messages: DataFrame, conversation: object = None) -> DataFrame:
    """Messages in order, of one conversation or of all."""
    if conversation is None:
        return messages.orderBy(CONV, TURN)
    return messages.where(F.col(CONV) == F.lit(conversation)).orderBy(TURN)


def search_messages(messages: DataFrame, keyword: str, conversation: object = None) -> DataFrame:
    found = messages.where(t.contains_ci(F.col("text"), keyword))
    return found if conversation is None else found.where(F.col(CONV) == F.lit(conversation))


def messages_by_role(messages: DataFrame, role: str) -> DataFrame:
    return messages.where(F.lower("role") == role.lower())


def statistics(messages: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    counts = messages.agg(F.count_distinct(CONV).alias("conversations"), F.count(F.lit(1)).alias("messages"))
    if memories is None:
        return counts
    return side_by_side(counts, memories.agg(F.count(F.lit(1)).alias("stored_memories")))


def analytics(messages: DataFrame) -> DataFrame:
    role = F.lower("role")
    return messages.groupBy(CONV).agg(
        F.count(F.lit(1)).alias("messages"),
        *[F.count_if(role == r).alias(f"{r}_messages") for r in ("user", "assistant", "tool", "system")],
        F.sum(F.length("text")).alias("characters"),
        F.sum(_tokens()).alias("tokens"),
    )


def estimate_cost(messages: DataFrame, price_per_1k: float = 0.01) -> DataFrame:
    """Decimal arithmetic up to the rounding."""
    price = F.lit(str(price_per_1k)).cast("decimal(18,6)")
    cost = F.round(F.col("tokens").cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)") * price, 4)
    return conversation_tokens(messages).withColumn("estimated_cost", cost.cast("double"))


def first_and_last(messages: DataFrame) -> DataFrame:
    m = F.struct("role", "text")
    ends = messages.groupBy(CONV).agg(F.min_by(m, TURN).alias("f"), F.max_by(m, TURN).alias("l"))
    return ends.select(
        CONV,
        F.col("f.role").alias("first_role"),
        F.col("f.text").alias("first_text"),
        F.col("l.role").alias("last_role"),
        F.col("l.text").alias("last_text"),
    )


# Memories: (memory_id, user_id, content, importance, created_at) --------------------------------------------------


def list_memories(memories: DataFrame, n: int = 10, user: str = "user_id") -> DataFrame:
    """The newest ``n`` memories of every user with the user's total."""
    totals = memories.groupBy(user).agg(F.count(F.lit(1)).alias("stored_memories"))
    recent = first_rows(memories, [user], [F.desc("created_at"), F.desc("memory_id")], n, "recency")
    return recent.withColumn("recency", F.col("recency").cast("long")).join(totals, user)


def search_memory(queries: DataFrame, memories: DataFrame, k: int = 5, **opts) -> DataFrame:
    """The k nearest memories of every query; both tables carry vectors."""
    from lorespan.operators.retrieve import search

    return search(queries, memories, k, **{"corpus_id": "memory_id", **opts})


def latest_state(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """An append-only table read as an upsert: the newest row per key."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return newest.select(*keys, "_s.*")


def delete_cascade(
    parents: DataFrame, children: DataFrame, ids: DataFrame, key: str = CONV
) -> tuple[DataFrame, DataFrame]:
    """Remove the listed parents and their children."""
    gone = ids.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def cleanup_memories(memories: DataFrame, minimum_importance: float = 0.2) -> DataFrame:
    return memories.where(~F.coalesce(F.col("importance") < minimum_importance, F.lit(False)))


def cleanup_conversations(
    conversations: DataFrame, messages: DataFrame, as_of: Column, days: int = 365
) -> tuple[DataFrame, DataFrame]:
    """Drop conversations idle for more than ``days`` before ``as_of``, with their messages."""
    stale = conversations.where(F.col("updated_at") < as_of - F.expr(f"interval {days} days"))
    return delete_cascade(conversations, messages, stale)
