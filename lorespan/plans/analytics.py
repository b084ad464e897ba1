"""Queries over conversations, usage, sessions, traces, metrics, logs and table profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorespan.operators import (
    conversation as conv,
    metricstore as ms,
    predicates as p,
    profile as pr,
    sessions as se,
    sketches as sk,
    skew,
    traces as tr,
    usage as us,
)
from lorespan.plans import sqltext as q
from lorespan.plans.registry import query
from lorespan.plans.retrieval import six_places
from lorespan.session import scratch_path
from lorespan.sources.tables import table

# Conversations ---------------------------------------------------------------------------------------------------


def messages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "conversations")


_TOK = "case when text = '' then 0 else greatest(1, length(text) // 4) end"
_NEWEST = "row_number() over (partition by conv_id order by turn desc)"


@query(
    "recent_messages",
    243,
    sql=f"select conv_id, turn, role, text from (select *, {_NEWEST} as n from conversations) where n <= 3",
)
def recent_messages(spark: SparkSession, root: str) -> DataFrame:
    return conv.recent_messages(messages(spark, root), 3)


_WINDOW = f"""w as (select *, {_TOK} as tokens, (sum({_TOK}) over (partition by conv_id order by turn desc))::bigint
    as window_tokens from conversations)"""


@query("context_window", 244, sql=f"with {_WINDOW} select * from w where window_tokens <= 300")
def context_window(spark: SparkSession, root: str) -> DataFrame:
    return conv.context_window(messages(spark, root), 300)


@query(
    "conversation_tokens", 245, sql=f"select conv_id, sum({_TOK})::bigint as tokens from conversations group by conv_id"
)
def conversation_tokens(spark: SparkSession, root: str) -> DataFrame:
    return conv.conversation_tokens(messages(spark, root))


_SUMMARY = f"""s as (select conv_id, string_agg(role || ': ' || case when length(text) > 120
    then substring(text, 1, 120) || '...' else text end, chr(10) order by turn) as summary
    from (select *, {_NEWEST} as n from conversations) where n <= 5 group by conv_id)"""


@query("summarize_conversations", 246, sql=f"with {_SUMMARY} select * from s")
def summarize_conversations(spark: SparkSession, root: str) -> DataFrame:
    return conv.summarize(messages(spark, root))


@query(
    "prompt_memory",
    247,
    sql=f"""with {_WINDOW}, {_SUMMARY}, k as (select conv_id, string_agg(role || '|' || text, chr(10) order by turn)
    as held from w where window_tokens <= 300 group by conv_id),
    t as (select conv_id, sum({_TOK})::bigint as token_count from conversations group by conv_id)
    select conv_id, coalesce(held, '') as held, summary, token_count from t join s using (conv_id)
    left join k using (conv_id)""",
)
def prompt_memory(spark: SparkSession, root: str) -> DataFrame:
    memory = conv.prompt_memory(messages(spark, root), 300)
    held = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "\n")
    return memory.select("conv_id", held.alias("held"), "summary", "token_count")


@query(
    "prune_history",
    248,
    sql=f"select conv_id, count(*) as kept from (select *, {_NEWEST} as n from conversations) where n <= 4 group by 1",
)
def prune_history(spark: SparkSession, root: str) -> DataFrame:
    return conv.prune_history(messages(spark, root), 4).groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"))


@query("get_messages", 249, sql="select conv_id, turn, role, text from conversations order by conv_id, turn")
def get_messages(spark: SparkSession, root: str) -> DataFrame:
    return conv.get_messages(messages(spark, root))


@query(
    "search_messages",
    32,
    sql="select conv_id, turn from conversations where contains(lower(text), 'tion')",
)
def search_messages(spark: SparkSession, root: str) -> DataFrame:
    return conv.search_messages(messages(spark, root), "TION").select("conv_id", "turn")


@query("messages_by_role", 33, sql="select conv_id, turn from conversations where lower(role) = 'system'")
def messages_by_role(spark: SparkSession, root: str) -> DataFrame:
    return conv.messages_by_role(messages(spark, root), "SYSTEM").select("conv_id", "turn")


@query(
    "memory_counts",
    250,
    sql="select count(distinct conv_id) as conversations, count(*) as messages, (select count(*) from events) "
    "as stored_memories from conversations",
)
def memory_counts(spark: SparkSession, root: str) -> DataFrame:
    return conv.statistics(messages(spark, root), memories(spark, root))


@query(
    "conversation_analytics",
    251,
    sql="select conv_id, count(*) as messages, "
    + ", ".join(f"count(*) filter (where role = '{r}') as {r}_messages" for r in ("user", "assistant", "tool", "system"))
    + f", sum(length(text))::bigint as characters, sum({_TOK})::bigint as tokens from conversations group by conv_id",
)
def conversation_analytics(spark: SparkSession, root: str) -> DataFrame:
    return conv.analytics(messages(spark, root))


@query(
    "conversation_cost",
    252,
    sql=f"""select conv_id, sum({_TOK})::bigint as tokens,
    round(sum({_TOK})::decimal(18, 0) * 0.01 / 1000, 4)::double as estimated_cost from conversations group by conv_id"""
    .replace("round(sum", "round((sum").replace("/ 1000, 4)", "* 0.001)::decimal(28, 8), 4)"),
)
def conversation_cost(spark: SparkSession, root: str) -> DataFrame:
    return conv.estimate_cost(messages(spark, root))


@query(
    "first_last_message",
    259,
    sql="""select conv_id, arg_min(role, turn) as first_role, arg_min(text, turn) as first_text,
    arg_max(role, turn) as last_role, arg_max(text, turn) as last_text from conversations group by conv_id""",
)
def first_last_message(spark: SparkSession, root: str) -> DataFrame:
    return conv.first_and_last(messages(spark, root))


# Memories: every event is a memory of its user, k / 100 its importance ---------------------------------------------

_K = "json_extract(props, '$.k')::int"


def memories(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        F.col("event_id").alias("memory_id"),
        "user_id",
        F.col("event_type").alias("content"),
        (F.from_json("props", "k int")["k"] / 100).alias("importance"),
        F.col("ts").alias("created_at"),
    )


@query(
    "list_memories",
    253,
    sql="""select user_id, event_id as memory_id, n as recency, t as stored_memories from (select *, row_number() over
    (partition by user_id order by ts desc, event_id desc) as n, count(*) over (partition by user_id) as t from events)
    where n <= 10""",
)
def list_memories(spark: SparkSession, root: str) -> DataFrame:
    return conv.list_memories(memories(spark, root)).select("user_id", "memory_id", "recency", "stored_memories")


@query(
    "search_memory",
    254,
    sql="""with e as (select vec_id, label, embedding::double[] as v from embeddings),
    s as (select a.vec_id as query_id, b.vec_id as memory_id, round(list_cosine_similarity(a.v, b.v), 9) as score
    from e a join e b on a.vec_id <> b.vec_id), k as (select *, row_number() over (partition by query_id
    order by score desc, memory_id) as rank from s)
    select query_id, memory_id, rank, round(score, 6) as score from k where rank <= 5""",
)
def search_memory(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    hits = conv.search_memory(
        e.select(F.col("vec_id").alias("query_id"), "embedding"),
        e.select(F.col("vec_id").alias("memory_id"), "embedding"),
        5,
        exclude_self=True,
        plan="blocks",
    )
    return hits.withColumn("score", six_places("score"))


@query(
    "latest_state",
    255,
    sql="""select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events
    group by user_id, event_type""",
)
def latest_state(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select("user_id", "event_type", "event_id", "ts")
    return conv.latest_state(rows, ["user_id", "event_type"], ["ts", "event_id"])


_LAST = "l as (select conv_id, max(turn) as last_turn, '2023-01-01'::timestamp + to_days((max(turn) * 60)::int) as updated_at from conversations group by conv_id)"


def _conversations(spark: SparkSession, root: str) -> DataFrame:
    """One row per conversation; the last turn stands for the time of the last update."""
    last = messages(spark, root).groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    days = (F.col("last_turn") * 60).cast("int")
    return last.withColumn("updated_at", F.date_add(F.lit("2023-01-01").cast("date"), days).cast("timestamp"))


@query(
    "delete_conversations",
    256,
    sql="""select 'parent' as kind, conv_id, null::bigint as turn from conversations group by conv_id
    having count(*) filter (where role = 'system') = 0 union all select 'child', conv_id, turn from conversations
    where conv_id not in (select conv_id from conversations where role = 'system')""",
)
def delete_conversations(spark: SparkSession, root: str) -> DataFrame:
    m = messages(spark, root)
    parents, children = conv.delete_cascade(m.select("conv_id").distinct(), m, m.where("role = 'system'"))
    return parents.select(F.lit("parent").alias("kind"), "conv_id", F.lit(None).cast("long").alias("turn")).unionByName(
        children.select(F.lit("child").alias("kind"), "conv_id", "turn")
    )


@query("cleanup_memories", 257, sql=f"select event_id as memory_id from events where not coalesce({_K} / 100 < 0.2, false)")
def cleanup_memories(spark: SparkSession, root: str) -> DataFrame:
    return conv.cleanup_memories(memories(spark, root)).select("memory_id")


@query(
    "cleanup_conversations",
    258,
    sql=f"""with {_LAST}, s as (select conv_id from l where updated_at < '2024-10-31'::timestamp - interval 365 day)
    select conv_id, turn from conversations where conv_id not in (select conv_id from s)""",
)
def cleanup_conversations(spark: SparkSession, root: str) -> DataFrame:
    as_of = F.lit("2024-10-31").cast("timestamp")
    kept = conv.cleanup_conversations(_conversations(spark, root), messages(spark, root), as_of)[1]
    return kept.select("conv_id", "turn")


# Usage: an event is a request; its type is the model, its value the duration, props.k its tokens ---------------------

_PROVIDERS = {"click": "openai", "view": "google", "purchase": "mistral", "signup": "anthropic", "error": "ollama"}
_PROVIDER_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _PROVIDERS.items()) + " end"
_PRICE_SQL = "case " + _PROVIDER_SQL + " " + " ".join(f"when '{k}' then {v}" for k, v in us.PRICES.items()) + " end"
_U = f"""u as (select *, total_tokens / 1000 * price as total_cost from (select event_id, user_id, ts as created_at,
    value as duration_ms, event_type as model, {_PROVIDER_SQL} as provider, {_PRICE_SQL}::double as price,
    user_id || '-' || ts::date as conversation_id, {_K} as prompt_tokens, {_K} * 2 as completion_tokens,
    {_K} // 10 as embedding_tokens, 0 as cached_tokens, {_K} + {_K} * 2 + {_K} // 10 as total_tokens from events))"""


def usage(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("k", F.from_json("props", "k int")["k"])
    provider = reduce(
        lambda acc, p: F.when(F.col("event_type") == p[0], p[1]).otherwise(acc), _PROVIDERS.items(), F.lit(None)
    )
    return e.select(
        "event_id",
        "user_id",
        F.col("ts").alias("created_at"),
        F.col("value").alias("duration_ms"),
        F.col("event_type").alias("model"),
        provider.alias("provider"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("conversation_id"),
        F.col("k").alias("prompt_tokens"),
        (F.col("k") * 2).alias("completion_tokens"),
        F.floor(F.col("k") / 10).cast("int").alias("embedding_tokens"),
        F.lit(0).alias("cached_tokens"),
    )


_HALF = "'2024-01-06'::timestamp and '2024-01-26'::timestamp - interval 1 microsecond"


def _stored_sketches(spark: SparkSession, root: str) -> DataFrame:
    """Daily sketches of the even and the odd requests, stored apart and merged."""
    path = scratch_path(spark, "sketches")
    for odd in (0, 1):
        part = usage(spark, root).where(F.pmod("event_id", F.lit(2)) == odd)
        made = sk.summarise(part, ["model"], distinct={"users": "user_id"}, quantiles={"duration": "duration_ms"})
        made.write.mode("append").parquet(path)
    return sk.merge(spark.read.parquet(path))


def _between(column: str) -> Column:
    return (F.col(column) >= F.lit("2024-01-06").cast("timestamp")) & (F.col(column) < F.lit("2024-01-26").cast("timestamp"))


@query(
    "distinct_users_from_sketches",
    270,
    284,
    285,
    318,
    sql=f"""select event_type as model, count(*) as requests, count(distinct user_id) as users, true as within_2_percent
    from events where ts between {_HALF} group by event_type""",
)
def distinct_users_from_sketches(spark: SparkSession, root: str) -> DataFrame:
    """Distinct users of three weeks from merged daily sketches, next to the exact count."""
    found = sk.report(sk.roll_up(_stored_sketches(spark, root).where(_between("period")), ["model"]))
    exact = usage(spark, root).where(_between("created_at")).groupBy("model").agg(F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("users") - F.col("exact")) <= 0.02 * F.col("exact")
    return found.join(exact, "model").select("model", F.col("rows").alias("requests"), F.col("exact").alias("users"), near.alias("within_2_percent"))


@query(
    "latency_from_sketches",
    227,
    234,
    308,
    313,
    sql=f"""select event_type as model, count(*) as requests, true as p50_within, true as p95_within, true as p99_within
    from events where ts between {_HALF} group by event_type""",
)
def latency_from_sketches(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of three weeks from merged daily sketches: their true ranks are within one in a hundred."""
    found = sk.report(sk.roll_up(_stored_sketches(spark, root).where(_between("period")), ["model"]))
    rows = usage(spark, root).where(_between("created_at")).join(found, "model")

    def within(p: float) -> Column:
        estimate, value = F.col(f"duration_p{100 * p:g}"), F.col("duration_ms")
        below, upto = F.avg((value < estimate).cast("int")), F.avg((value <= estimate).cast("int"))
        return ((below - 0.01 <= p) & (p <= upto + 0.01)).alias(f"p{100 * p:g}_within")

    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), within(0.5), within(0.95), within(0.99))


_KINDS = ", ".join(f"sum({k})::bigint as {k}" for k in us.TOKEN_KINDS)


@query(
    "token_totals",
    260,
    261,
    264,
    sql=f"""with {_U} select conversation_id, {_KINDS}, sum(total_tokens)::bigint as total_tokens,
    round(sum(total_cost), 6) as total_cost, case when sum(total_tokens) = 0 then 0 else
    round(sum(total_cost) / sum(total_tokens), 8) end as average_token_cost from u group by conversation_id""",
)
def token_totals(spark: SparkSession, root: str) -> DataFrame:
    return us.token_statistics(usage(spark, root), ["conversation_id"])


@query(
    "token_breakdown",
    262,
    sql=f"with {_U} select event_id, "
    + ", ".join(
        f"round({k} / greatest(total_tokens, 1) * 100, 2) as {k.replace('tokens', 'percent')}" for k in us.TOKEN_KINDS
    )
    + " from u",
)
def token_breakdown(spark: SparkSession, root: str) -> DataFrame:
    return us.token_breakdown(usage(spark, root), ["event_id"])


@query(
    "compare_usage",
    263,
    sql=f"""with {_U}, p as (select *, lag(total_tokens) over w as t, lag(total_cost) over w as c, lag(provider) over w
    as p, lag(model) over w as m, lag(event_id) over w as e from u window w as (partition by user_id
    order by created_at, event_id)) select event_id, t - total_tokens as token_difference,
    round(c - total_cost, 6) as cost_difference, p = provider as same_provider, m = model as same_model from p
    where e is not null""",
)
def compare_usage(spark: SparkSession, root: str) -> DataFrame:
    """Every request against the user's request before it."""
    rows = us.with_totals(usage(spark, root)).withColumn(
        "b", F.struct("total_tokens", "total_cost", "provider", "model")
    )
    pairs = skew.previous_value(
        rows, ["user_id"], ["created_at", "event_id"], F.date_trunc("hour", "created_at"), "b", "a"
    )
    return us.compare_usage(pairs.where("a is not null"), ["event_id"])


@query(
    "usage_totals",
    266,
    sql=f"""with {_U} select count(*) as total_chats, sum(total_tokens)::bigint as total_tokens,
    round(avg(duration_ms), 2) as average_latency from u""",
)
def usage_totals(spark: SparkSession, root: str) -> DataFrame:
    return us.totals(usage(spark, root))


@query("model_statistics", 267, sql=f"with {_U} select provider, model, count(*) as requests from u group by all")
def model_statistics(spark: SparkSession, root: str) -> DataFrame:
    return us.model_statistics(usage(spark, root))


@query(
    "top_models",
    267,
    sql=f"with {_U} select provider, model, count(*) as requests from u group by all "
    "order by requests desc, provider, model limit 3",
)
def top_models(spark: SparkSession, root: str) -> DataFrame:
    return us.top_models(usage(spark, root), 3)


@query("provider_statistics", 268, sql=f"with {_U} select provider, count(*) as requests from u group by all")
def provider_statistics(spark: SparkSession, root: str) -> DataFrame:
    return us.provider_statistics(usage(spark, root))


@query(
    "conversation_usage",
    269,
    sql=f"""with {_U} select conversation_id, count(*) filter (where model <> 'error') as requests,
    coalesce(sum(total_tokens) filter (where model <> 'view'), 0)::bigint as tokens from u group by conversation_id
    having count(*) filter (where model <> 'error') > 0 or count(*) filter (where model <> 'view') > 0""",
)
def conversation_usage(spark: SparkSession, root: str) -> DataFrame:
    u = us.with_totals(usage(spark, root))
    return us.conversation_statistics(u.where("model <> 'error'"), u.where("model <> 'view'"))


@query(
    "user_statistics",
    270,
    sql=f"""with {_U} select user_id, count(*) as activities, count(distinct conversation_id) as conversations from u
    group by user_id""",
)
def user_statistics(spark: SparkSession, root: str) -> DataFrame:
    return us.user_statistics(usage(spark, root))


@query(
    "daily_report",
    271,
    sql=f"""with {_U} select '2024-01-15' as date, count(*) as requests, coalesce(sum(total_tokens), 0)::bigint as tokens
    from u where created_at::date = '2024-01-15'""",
)
def daily_report(spark: SparkSession, root: str) -> DataFrame:
    return us.daily_report(usage(spark, root), "2024-01-15")


@query(
    "daily_trend",
    272,
    sql=f"with {_U} select created_at::date as day, count(*) as requests from u group by 1 order by day desc limit 7",
)
def daily_trend(spark: SparkSession, root: str) -> DataFrame:
    return us.daily_trend(usage(spark, root), 7)


@query(
    "rag_statistics",
    273,
    sql=f"""select count(*) as queries, round(avg({_K}), 6) as average_chunks, round(avg(value / 500), 6)
    as average_similarity, round(avg(value), 6) as average_latency from events""",
)
def rag_statistics(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select(
        F.from_json("props", "k int")["k"].alias("retrieved_chunks"),
        (F.col("value") / 500).alias("similarity_score"),
        F.col("value").alias("retrieval_time_ms"),
    )
    return us.rag_statistics(rows)


@query(
    "memory_statistics",
    274,
    sql=f"""select count(*) as requests, round(avg({_K}), 6) as average_memories, round(avg(value), 6) as average_tokens
    from events""",
)
def memory_statistics(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select(
        F.from_json("props", "k int")["k"].alias("memories_used"), F.col("value").alias("memory_tokens")
    )
    return us.memory_statistics(rows)


@query(
    "top_users",
    275,
    sql=f"with {_U} select user_id, count(*) as requests from u group by 1 order by requests desc, user_id limit 10",
)
def top_users(spark: SparkSession, root: str) -> DataFrame:
    return us.top_users(usage(spark, root))


@query(
    "performance_report",
    276,
    sql="select min(value) as fastest, max(value) as slowest, round(avg(value), 6) as average from events",
)
def performance_report(spark: SparkSession, root: str) -> DataFrame:
    return us.performance_report(usage(spark, root))


@query(
    "dashboard",
    277,
    sql=f"""with {_U}, n as (select 'total_chats' as metric, 'all' as key, count(*)::double as value from u
    union all select 'total_tokens', 'all', sum(total_tokens)::double from u
    union all select 'average_latency', 'all', round(avg(duration_ms), 2) from u
    union all select 'fastest', 'all', min(duration_ms) from u union all select 'slowest', 'all', max(duration_ms) from u
    union all select 'users', 'all', count(distinct user_id)::double from u
    union all select 'requests_by_model', model, count(*)::double from u group by model
    union all select 'requests_by_provider', provider, count(*)::double from u group by provider
    union all select * from (select 'requests_by_day', created_at::date::varchar as k, count(*)::double from u group by k
    order by k desc limit 30) union all select * from (select 'requests_by_user', user_id::varchar as k,
    count(*)::double as c from u group by k order by c desc, k limit 10)) select * from n""",
)
def dashboard(spark: SparkSession, root: str) -> DataFrame:
    return us.dashboard(usage(spark, root))


@query(
    "token_usage",
    278,
    sql=f"""with {_U} select provider, model, grouping(provider, model) as level, count(*) as requests,
    sum(total_tokens)::bigint as tokens, round(sum(total_cost), 6) as cost from u group by rollup (provider, model)""",
)
def token_usage(spark: SparkSession, root: str) -> DataFrame:
    return us.token_usage(usage(spark, root))


_SUMS = "count(*) as requests, sum(total_tokens)::bigint as tokens, round(sum(total_cost), 6) as cost from u group by all"


@query("usage_by_day", 279, sql=f"with {_U} select created_at::date as day, {_SUMS}")
def usage_by_day(spark: SparkSession, root: str) -> DataFrame:
    return us.usage_by(usage(spark, root), [F.to_date("created_at").alias("day")])


@query("usage_by_user", 279, sql=f"with {_U} select user_id, {_SUMS}")
def usage_by_user(spark: SparkSession, root: str) -> DataFrame:
    return us.usage_by(usage(spark, root), [F.col("user_id")])


@query("usage_by_conversation", 279, sql=f"with {_U} select conversation_id, {_SUMS}")
def usage_by_conversation(spark: SparkSession, root: str) -> DataFrame:
    return us.usage_by(usage(spark, root), [F.col("conversation_id")])


@query(
    "search_period",
    280,
    sql="select event_id from events where ts >= '2024-01-10' and ts < '2024-01-12 12:00:00'",
)
def search_period(spark: SparkSession, root: str) -> DataFrame:
    return us.between(usage(spark, root), "2024-01-10", "2024-01-12 12:00:00").select("event_id")


@query(
    "retain_events",
    281,
    sql="select event_id from events where ts::date >= '2024-01-31'::date - 14",
)
def retain_events(spark: SparkSession, root: str) -> DataFrame:
    return us.retain(usage(spark, root), "2024-01-31", 14).select("event_id")


@query(
    "success_rate",
    282,
    sql="""select user_id, count(*) filter (where event_type <> 'error') as successes, count(*) filter
    (where event_type = 'error') as failures, round(count(*) filter (where event_type <> 'error') / count(*) * 100, 2)
    as success_rate from events group by user_id""",
)
def success_rate(spark: SparkSession, root: str) -> DataFrame:
    return us.success_rate(usage(spark, root), F.col("model") == "error", ["user_id"])


_S = """g as (select *, coalesce(ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour, true)
    ::int as fresh from events), n as (select *, sum(fresh) over (partition by user_id order by ts, event_id)::bigint
    as session_no from g), s as (select user_id, session_no, min(ts) as created_at, max(ts) as last_activity,
    count(*) as events, max(ts) + interval 1 day as expires_at from n group by user_id, session_no)"""


def sessions(spark: SparkSession, root: str) -> DataFrame:
    return se.session_table(se.sessionize(table(spark, root, "events")))


@query(
    "session_ratios",
    283,
    sql=f"""with {_U}, {_S}, a as (select count(*) as messages, sum(total_tokens)::bigint as tokens,
    count(distinct user_id) as users from u), b as (select count(*) as sessions from s)
    select *, round(messages / sessions, 2) as messages_per_session, round(tokens / sessions, 2) as tokens_per_session
    from a, b""",
)
def session_ratios(spark: SparkSession, root: str) -> DataFrame:
    return us.session_ratios(usage(spark, root), sessions(spark, root))


_PC = """count(*) as requests, sum(total_tokens)::bigint as tokens, round(sum(duration_ms), 4) as duration_sum,
    count(duration_ms) as duration_count from u group by 1"""


def _period(name: str, period: str) -> None:
    @query(
        f"usage_{name}",
        284,
        sql=f"with {_U} select date_trunc('{us.PERIODS[name]}', created_at)::timestamp as period, {_PC}",
    )
    def run(spark: SparkSession, root: str) -> DataFrame:
        return us.period_counters(usage(spark, root), name).withColumn("duration_sum", F.round("duration_sum", 4))


for _p in us.PERIODS:
    _period(_p, us.PERIODS[_p])


@query(
    "usage_calendar",
    284,
    sql=f"""with {_U} select year(created_at) as year, month(created_at) as month, day(created_at) as day,
    grouping(year(created_at), month(created_at), day(created_at)) as level, count(*) as requests from u
    group by rollup (year(created_at), month(created_at), day(created_at))""",
)
def usage_calendar(spark: SparkSession, root: str) -> DataFrame:
    return us.calendar_rollup(usage(spark, root))


@query(
    "merge_periods",
    285,
    sql=f"""with {_U} select count(*) as requests, sum(total_tokens)::bigint as tokens, round(avg(duration_ms), 4)
    as average_latency from u""",
)
def merge_periods(spark: SparkSession, root: str) -> DataFrame:
    u = usage(spark, root)
    halves = [us.between(u, "0001-01-01", "2024-01-16"), us.between(u, "2024-01-16", "9999-12-31")]
    return us.merge_counters(*[us.period_counters(h, "daily").drop("period") for h in halves])


# Sessions and security -------------------------------------------------------------------------------------------

AS_OF = "2024-01-30 12:00:00"
_ACTIVE = f"{_S}, x as (select *, expires_at >= '{AS_OF}'::timestamp as is_active from s)"


def _expired(spark: SparkSession, root: str) -> DataFrame:
    return se.expire(sessions(spark, root), AS_OF)


@query("session_table", 289, 293, sql=f"with {_ACTIVE} select * from x")
def session_table(spark: SparkSession, root: str) -> DataFrame:
    return _expired(spark, root)


@query(
    "active_sessions",
    286,
    sql=f"""with {_ACTIVE} select user_id, count(*) filter (where is_active) as active, count(*) as total,
    count(*) filter (where not is_active) as expired from x group by user_id""",
)
def active_sessions(spark: SparkSession, root: str) -> DataFrame:
    return se.active_sessions(_expired(spark, root), ["user_id"])


@query(
    "session_statistics",
    287,
    sql=f"with {_ACTIVE} select count(*) as sessions, count(distinct user_id) as users from x where is_active",
)
def session_statistics(spark: SparkSession, root: str) -> DataFrame:
    return se.session_statistics(_expired(spark, root))


@query(
    "idle_times",
    288,
    sql=f"""with {_ACTIVE} select user_id, session_no,
    round(epoch_us('{AS_OF}'::timestamp) / 1e6 - epoch_us(last_activity) / 1e6, 2) as idle_seconds,
    round(epoch_us('{AS_OF}'::timestamp) / 1e6 - epoch_us(created_at) / 1e6, 2) as duration_seconds from x""".replace(
        "/ 1e6 - epoch_us(last_activity) / 1e6", "- epoch_us(last_activity)) / 1e6"
    )
    .replace("/ 1e6 - epoch_us(created_at) / 1e6", "- epoch_us(created_at)) / 1e6")
    .replace("round(epoch_us", "round((epoch_us"),
)
def idle_times(spark: SparkSession, root: str) -> DataFrame:
    return se.idle_times(_expired(spark, root), AS_OF).select(
        "user_id", "session_no", "idle_seconds", "duration_seconds"
    )


@query(
    "active_conversations",
    290,
    sql="""select user_id, arg_max(event_type, (ts, event_id)) as conversation, max(ts) as updated_at from events
    group by user_id""",
)
def active_conversations(spark: SparkSession, root: str) -> DataFrame:
    return se.active_conversations(table(spark, root, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(
    "login_history",
    291,
    sql="""select user_id, event_id, n as recency from (select *, row_number() over (partition by user_id
    order by ts desc, event_id desc) as n from events) where n <= 20""",
)
def login_history(spark: SparkSession, root: str) -> DataFrame:
    logins = table(spark, root, "events").select("user_id", "event_id", "ts")
    return se.login_history(logins, 20, order=("ts", "event_id")).drop("ts")


@query("last_activity", 293, sql="select user_id, max(ts) as last_activity from events group by user_id")
def last_activity(spark: SparkSession, root: str) -> DataFrame:
    return se.last_activity(table(spark, root, "events"), "user_id")


@query(
    "logout_sessions",
    294,
    sql=f"""with {_ACTIVE}, b as (select distinct user_id from events where event_type = 'error' and value > 400)
    select user_id, session_no, is_active and user_id not in (select user_id from b) as is_active from x""",
)
def logout_sessions(spark: SparkSession, root: str) -> DataFrame:
    gone = table(spark, root, "events").where("event_type = 'error' and value > 400")
    return se.logout(_expired(spark, root), gone, ["user_id"]).select("user_id", "session_no", "is_active")


@query("device_statistics", 295, sql="select event_type, count(*) as logins from events group by event_type")
def device_statistics(spark: SparkSession, root: str) -> DataFrame:
    return se.logins_by(table(spark, root, "events"), "event_type")


@query(
    "trusted_devices",
    296,
    sql="""select user_id as device_id from events group by user_id having bool_or(value > 350)
    and user_id not in (select user_id from events where event_type = 'error' and value > 400)""",
)
def trusted_devices(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumnRenamed("user_id", "device_id")
    devices = e.groupBy("device_id").agg(F.bool_or(F.col("value") > 350).alias("trusted"))
    return se.trusted_devices(devices, e.where("event_type = 'error' and value > 400")).select("device_id")


def failures(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").where("event_type = 'error'")


_ALERTS = """al as (select user_id, ts::date as day, count(*) as failures, 'HIGH' as severity,
    'Too many failed logins' as description from events where event_type = 'error' group by user_id, ts::date
    having count(*) >= 3)"""


@query("suspicious_activity", 297, sql=f"with {_ALERTS} select * from al")
def suspicious_activity(spark: SparkSession, root: str) -> DataFrame:
    return se.failed_login_alerts(failures(spark, root), 3)


@query(
    "security_statistics",
    298,
    sql=f"""with {_ALERTS} select (select count(*) from events where event_type = 'error') as failed_logins,
    (select count(*) from al) as security_alerts""",
)
def security_statistics(spark: SparkSession, root: str) -> DataFrame:
    f = failures(spark, root)
    return se.security_statistics(f, se.failed_login_alerts(f, 3))


@query(
    "security_cleanup",
    299,
    sql="""select 'failed_logins' as name, event_id from events where event_type = 'error'
    and ts::date >= '2024-01-31'::date - 10 union all select 'login_history', event_id from events
    where event_type = 'signup' and ts::date >= '2024-01-31'::date - 10""",
)
def security_cleanup(spark: SparkSession, root: str) -> DataFrame:
    logins = table(spark, root, "events").where("event_type = 'signup'").withColumnRenamed("ts", "login_time")
    kept = se.cleanup(
        {"failed_logins": (failures(spark, root), "ts"), "login_history": (logins, "login_time")}, "2024-01-31", 10
    )
    parts = [df.select(F.lit(name).alias("name"), "event_id") for name, df in kept.items()]
    return reduce(DataFrame.unionByName, parts)


# Traces: a trace is a user's day, a span is an event -----------------------------------------------------------------

_TYPES = {"click": "llm", "view": "retrieval", "purchase": "tool", "signup": "database", "error": "http"}


def spans(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    kind = reduce(lambda acc, p: F.when(F.col("event_type") == p[0], p[1]).otherwise(acc), _TYPES.items(), F.lit(None))
    failed = F.col("event_type") == "error"
    text = lambda v: F.lit(v)
    raised = F.array(
        F.struct(
            text("exception").alias("name"),
            F.col("ts").alias("ts"),
            F.create_map(
                text("type"), F.when(F.col("value") > 100, "Timeout").otherwise("ValueError"),
                text("message"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")),
            ).alias("attributes"),
        )
    )
    end = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long"))
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("trace_id"),
        F.col("event_id").alias("span_id"),
        F.col("event_type").alias("name"),
        kind.alias("span_type"),
        F.when(failed, "error").when(F.col("value") > 400, "unset").otherwise("ok").alias("status"),
        F.col("ts").alias("start_time"),
        F.when(F.col("value") <= 400, end).alias("end_time"),
        F.create_map(F.lit("model"), F.concat(F.lit("m"), F.col("user_id").cast("string"))).alias("attributes"),
        F.when(failed, raised).otherwise(F.array().cast(raised_type())).alias("events"),
    )


def raised_type() -> str:
    return "array<struct<name:string,ts:timestamp,attributes:map<string,string>>>"


_TYPE_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _TYPES.items()) + " end"
_SP = f"""sp as (select user_id || '-' || ts::date as trace_id, event_id as span_id, event_type as name,
    {_TYPE_SQL} as span_type, case when event_type = 'error' then 'error' when value > 400 then 'unset'
    else 'ok' end as status, ts as start_time, case when value <= 400 then
    make_timestamp(epoch_us(ts) + round(value * 1000)::bigint) end as end_time, 'm' || user_id as model, value, props
    from events), d as (select *, round((epoch_us(end_time) - epoch_us(start_time)) / 1000, 3) as ms from sp)"""


@query(
    "search_spans",
    38,
    sql=f"with {_SP} select span_id from d where contains(name, 'view') or contains(lower('{{\"model\":\"' || model || '\"}}'), 'view')",
)
def search_spans(spark: SparkSession, root: str) -> DataFrame:
    return tr.search_spans(spans(spark, root), "VIEW").select("span_id")


@query(
    "filter_spans",
    39,
    sql=f"with {_SP} select span_id from d where status = 'ok' and span_type = 'tool'",
)
def filter_spans(spark: SparkSession, root: str) -> DataFrame:
    return tr.filter_spans(spans(spark, root), "ok", "tool").select("span_id")


@query(
    "trace_statistics",
    300,
    sql=f"""with {_SP} select count(distinct trace_id) as trace_count, count(*) as span_count,
    count(*) filter (where end_time is null) as active_spans, count(end_time) as completed_spans,
    count(*) filter (where status = 'error') as error_spans from d""",
)
def trace_statistics(spark: SparkSession, root: str) -> DataFrame:
    return tr.statistics(spans(spark, root))


_TS = """ts as (select trace_id, count(*) as span_count, count(end_time) as completed_spans,
    count(*) filter (where status = 'error') as error_spans,
    round((epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1000, 3) as duration_ms,
    round(avg(ms), 6) as average_span_duration_ms from d group by trace_id)"""


@query("trace_summaries", 301, sql=f"with {_SP}, {_TS} select * from ts")
def trace_summaries(spark: SparkSession, root: str) -> DataFrame:
    return tr.trace_summaries(spans(spark, root))


@query(
    "mean_durations",
    302,
    sql=f"""with {_SP}, {_TS} select (select round(avg(duration_ms), 3) from ts) as average_trace_duration,
    (select round(avg(ms), 3) from d where end_time is not null) as average_span_duration""",
)
def mean_durations(spark: SparkSession, root: str) -> DataFrame:
    return tr.mean_durations(spans(spark, root))


@query(
    "span_types",
    303,
    sql=f"""with {_SP} select t as span_type, (select count(*) from d where span_type = t) as spans
    from (select unnest({list(tr.SPAN_TYPES)}) as t)""",
)
def span_types(spark: SparkSession, root: str) -> DataFrame:
    return tr.counts_with_zeros(spans(spark, root), "span_type", tr.SPAN_TYPES)


@query(
    "span_states",
    303,
    sql=f"""with {_SP} select t as status, (select count(*) from d where status = t) as spans
    from (select unnest({list(tr.STATES)}) as t)""",
)
def span_states(spark: SparkSession, root: str) -> DataFrame:
    return tr.counts_with_zeros(spans(spark, root), "status", tr.STATES)


@query(
    "span_exceptions",
    304,
    sql="""select case when value > 100 then 'Timeout' else 'ValueError' end as exception_type,
    'k=' || json_extract_string(props, '$.k') as message, count(*) as occurrences from events where event_type = 'error'
    group by all""",
)
def span_exceptions(spark: SparkSession, root: str) -> DataFrame:
    return tr.exceptions(spans(spark, root))


@query(
    "span_attributes",
    305,
    sql=f"""with {_SP} select model, count(*) as spans, round(avg(ms), 3) as average_ms from d where span_type = 'llm'
    group by model""",
)
def span_attributes(spark: SparkSession, root: str) -> DataFrame:
    return tr.attribute_statistics(spans(spark, root), "llm", "model")


# Metrics, health, logs -----------------------------------------------------------------------------------------------

_METRIC = "case event_type when 'click' then 'counter' when 'signup' then 'counter' when 'view' then 'gauge' else 'histogram' end"
_SM = f"sm as (select event_type as name, {_METRIC} as type, ts, value, event_id from events)"


def samples(spark: SparkSession, root: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type").isin("click", "signup"), "counter")
        .when(F.col("event_type") == "view", "gauge")
        .otherwise("histogram")
    )
    return table(spark, root, "events").select(
        F.col("event_type").alias("name"), kind.alias("type"), "ts", "value", "event_id"
    )


@query(
    "metric_counters",
    306,
    sql=f"with {_SM} select name, round(sum(value), 4) as value from sm where type = 'counter' group by name",
)
def metric_counters(spark: SparkSession, root: str) -> DataFrame:
    return ms.counters(samples(spark, root)).withColumn("value", F.round("value", 4))


@query(
    "metric_gauges",
    307,
    sql=f"with {_SM} select name, arg_max(value, (ts, event_id)) as value from sm where type = 'gauge' group by name",
)
def metric_gauges(spark: SparkSession, root: str) -> DataFrame:
    return ms.gauges(samples(spark, root), "event_id")


@query(
    "metric_histograms",
    308,
    sql=f"""with {_SM} select name, count(*) as count, round(sum(value), 4) as sum, arg_max(value, (ts, event_id)) as last
    from sm where type = 'histogram' group by name""",
)
def metric_histograms(spark: SparkSession, root: str) -> DataFrame:
    return ms.histograms(samples(spark, root), "event_id").withColumn("sum", F.round("sum", 4))


@query(
    "histogram_quantiles",
    308,
    sql=f"""with {_SM} select name, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4)
    as p95, round(quantile_cont(value, 0.99), 4) as p99 from sm where type = 'histogram' group by name""",
)
def histogram_quantiles(spark: SparkSession, root: str) -> DataFrame:
    quantiles = ms.histogram_quantiles(samples(spark, root))
    return quantiles.select("name", *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")])


@query(
    "metrics_summary",
    309,
    sql=f"""with {_SM}, p as (select name, type, count(*) as n, sum(value) as total, arg_max(value, ts) as last from sm
    group by all) select count(*) filter (where type = 'counter') as counters, count(*) filter (where type = 'gauge')
    as gauges, count(*) filter (where type = 'histogram') as histograms, count(*) as total_metrics,
    round(sum(total) filter (where type = 'counter'), 4) as counter_total, round(avg(last) filter (where type = 'gauge'),
    2) as average_gauge, sum(n) filter (where type = 'histogram')::bigint as histogram_samples from p""",
)
def metrics_summary(spark: SparkSession, root: str) -> DataFrame:
    return ms.statistics(samples(spark, root))


@query("search_metrics", 40, sql=f"with {_SM} select distinct name, type from sm where contains(name, 'c') and type = 'counter'")
def search_metrics(spark: SparkSession, root: str) -> DataFrame:
    return ms.search(samples(spark, root), "C", "counter")


_PROBE = "case event_type when 'click' then 'CPU' when 'view' then 'Memory' when 'purchase' then 'Disk' else event_type end"
_CK = f"""ck as (select event_id, user_id, {_PROBE} as name, value / 5 as v, case when {_PROBE} = 'CPU' then
    case when value / 5 >= 90 then 'critical' when value / 5 >= 75 then 'warning' else 'healthy' end
    when {_PROBE} in ('Memory', 'Disk') then case when value / 5 >= 95 then 'critical' when value / 5 >= 80
    then 'warning' else 'healthy' end else 'unknown' end as status from events)"""


def checks(spark: SparkSession, root: str) -> DataFrame:
    probe = (
        F.when(F.col("event_type") == "click", "CPU")
        .when(F.col("event_type") == "view", "Memory")
        .when(F.col("event_type") == "purchase", "Disk")
        .otherwise(F.col("event_type"))
    )
    rows = table(spark, root, "events").select("event_id", "user_id", probe.alias("name"), (F.col("value") / 5).alias("value"))
    return ms.check(rows)


@query("health_checks", 310, sql=f"with {_CK} select event_id, name, status from ck")
def health_checks(spark: SparkSession, root: str) -> DataFrame:
    return checks(spark, root).select("event_id", "name", "status")


@query(
    "health_status",
    311,
    sql=f"""with {_CK} select user_id, case when bool_or(status = 'critical') then 'critical' when bool_or(status = 'warning')
    then 'warning' when bool_or(status = 'healthy') then 'healthy' else 'unknown' end as overall_status,
    count(*) as total_checks, count(*) filter (where status = 'healthy') as healthy,
    count(*) filter (where status = 'warning') as warnings, count(*) filter (where status = 'critical') as critical
    from ck group by user_id""",
)
def health_status(spark: SparkSession, root: str) -> DataFrame:
    return ms.overall_status(checks(spark, root), ("user_id",))


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every event as a JSON log line; error lines are cut off, as a crashed writer leaves them."""
    line = F.to_json(
        F.struct(
            F.col("ts").cast("string").alias("timestamp"),
            F.when(F.col("event_type") == "view", "HTTP Request").otherwise("Performance").alias("message"),
            F.col("event_type").alias("operation"),
            F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"),
            F.col("value").alias("latency_ms"),
        )
    )
    cut = F.when(F.col("event_type") == "error", F.expr("substring(_line, 1, 30)")).otherwise(F.col("_line"))
    return table(spark, root, "events").withColumn("_line", line).select("event_id", cut.alias("value"))


@query(
    "log_statistics",
    312,
    sql="""select case when event_type = 'view' then 'HTTP Request' else 'Performance' end as message,
    event_type as operation, count(*) as records, round(avg(value), 4) as average_latency from events
    where event_type <> 'error' group by all""",
)
def log_statistics(spark: SparkSession, root: str) -> DataFrame:
    return ms.log_statistics(ms.parse_logs(log_lines(spark, root)))


@query(
    "request_latency",
    313,
    sql="""select '/u/' || user_id as path, count(*) as requests, round(avg(value), 4) as average, max(value) as slowest,
    round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95 from events
    where event_type = 'view' group by all""",
)
def request_latency(spark: SparkSession, root: str) -> DataFrame:
    records = ms.parse_logs(log_lines(spark, root)).where("message = 'HTTP Request'")
    return ms.request_latency(records)


@query(
    "account_age",
    314,
    sql="""select user_id, date_diff('day', min(ts)::date, '2024-03-01'::date) as age_days, count(*) as logins,
    max(ts) as last_login from events group by user_id""",
)
def account_age(spark: SparkSession, root: str) -> DataFrame:
    return p.user_facts(table(spark, root, "events"), "2024-03-01")


# Profiles --------------------------------------------------------------------------------------------------------------

_LI = "li as (select *, nullif(l_quantity, 1) as q from lineitem)"


def items(spark: SparkSession, root: str) -> DataFrame:
    """Line items with the quantity 1 taken as missing."""
    return table(spark, root, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(1.0)))


_LCOLS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus "
    "l_shipdate"
).split()


@query(
    "missing_values",
    315,
    sql=f"with {_LI}, "
    + "m as ("
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) - count({'q' if c == 'l_quantity' else c}) as missing, count(*) as n from li"
        for c in _LCOLS
    )
    + ') select "column", missing, round(missing / n * 100, 2) as percentage from m',
)
def missing_values(spark: SparkSession, root: str) -> DataFrame:
    return pr.missing_values(items(spark, root))


@query("null_rows", 316, sql=f"with {_LI} select count(*) filter (where q is null) as null_rows from li")
def null_rows(spark: SparkSession, root: str) -> DataFrame:
    return pr.null_row_count(items(spark, root))


@query(
    "column_kinds",
    317,
    26,
    sql="""select * from (values (0, 'c_custkey', 'bigint', 'numeric'), (1, 'c_name', 'string', 'categorical'),
    (2, 'c_nationkey', 'int', 'numeric'), (3, 'c_acctbal', 'double', 'numeric'), (4, 'c_mktsegment', 'string',
    'categorical')) t(position, name, type, kind)""",
)
def column_kinds(spark: SparkSession, root: str) -> DataFrame:
    return pr.columns_table(table(spark, root, "customer"))


@query("table_shape", 26, sql="select count(*) as rows, 11 as columns from lineitem")
def table_shape(spark: SparkSession, root: str) -> DataFrame:
    return pr.shape(table(spark, root, "lineitem"))


def _described(c: str, numeric: bool, where: str) -> str:
    if numeric:
        return f"""select '{c}' as "column", count({c}) as count, null::bigint as "unique", null::varchar as top,
        null::bigint as freq, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c})::double as min,
        max({c})::double as max, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50,
        round(quantile_cont({c}, 0.75), 6) as q75 from {where}"""
    return f"""select '{c}', (select count({c}) from {where}), count(*), arg_min(v, (-n, v)), max(n), null, null, null,
        null, null, null, null from (select {c}::varchar as v, count(*) as n from {where} where {c} is not null
        group by 1)"""


@query(
    "describe_customers",
    318,
    sql=" union all ".join(
        _described(c, c not in ("c_name", "c_mktsegment"), "customer")
        for c in ("c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment")
    ),
)
def describe_customers(spark: SparkSession, root: str) -> DataFrame:
    return pr.describe(table(spark, root, "customer"))


_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = lambda f, src: " union all ".join(
    f"select '{a}' as \"left\", '{b}' as \"right\", round({f(a, b)}, 6) as correlation from {src}"
    for i, a in enumerate(_NUM)
    for b in _NUM[i + 1 :]
)


@query("correlation", 319, sql=_CORR(lambda a, b: f"corr({a}, {b})", "lineitem"))
def correlation(spark: SparkSession, root: str) -> DataFrame:
    return pr.correlation(table(spark, root, "lineitem"), columns=_NUM)


@query(
    "correlation_ranks",
    319,
    sql="with r as (select "
    + ", ".join(
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as {c}" for c in _NUM
    )
    + " from lineitem) "
    + _CORR(lambda a, b: f"corr({a}, {b})", "r"),
)
def correlation_ranks(spark: SparkSession, root: str) -> DataFrame:
    return pr.correlation(table(spark, root, "lineitem"), "spearman", _NUM, pairwise=False)


_HOLES = "select nullif(l_quantity, 1) as q, l_tax as t, nullif(l_discount, 0) as d from lineitem"


@query(
    "correlation_ranks_pairwise",
    319,
    sql=f"with h as ({_HOLES}) "
    + " union all ".join(
        f"""select '{a}' as "left", '{b}' as "right", (select round(corr(x, y), 6) from (
        select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2 as x,
        rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2 as y
        from h where {a} is not null and {b} is not null)) as correlation"""
        for a, b in (("q", "t"), ("q", "d"), ("t", "d"))
    ),
)
def correlation_ranks_pairwise(spark: SparkSession, root: str) -> DataFrame:
    table(spark, root, "lineitem").createOrReplaceTempView("_holes")
    return pr.correlation(spark.sql(_HOLES.replace("lineitem", "_holes")), "spearman")


_TAU = ["p_partkey", "p_size", "p_retailprice"]


@query(
    "correlation_kendall",
    319,
    sql=" union all ".join(
        f"""select '{a}' as "left", '{b}' as "right", round(sum(sign(s.{a} - t.{a}) * sign(s.{b} - t.{b})) /
        sqrt(sum((s.{a} <> t.{a})::int)) / sqrt(sum((s.{b} <> t.{b})::int)), 6) as correlation
        from part s join part t on s.p_partkey < t.p_partkey"""
        for i, a in enumerate(_TAU)
        for b in _TAU[i + 1 :]
    ),
)
def correlation_kendall(spark: SparkSession, root: str) -> DataFrame:
    return pr.correlation(table(spark, root, "part"), "kendall", _TAU)


@query("value_counts", 320, sql=f"with {_LI} select q as l_quantity, count(*) as count from li group by q")
def value_counts(spark: SparkSession, root: str) -> DataFrame:
    return pr.value_counts(items(spark, root), "l_quantity")


@query(
    "value_shares",
    320,
    sql=f"""with {_LI} select q as l_quantity, count(*) as count, round(count(*) / (select count(*) from li), 6) as share
    from li group by q""",
)
def value_shares(spark: SparkSession, root: str) -> DataFrame:
    return pr.value_counts(items(spark, root), "l_quantity", normalize=True)


@query(
    "table_summary",
    321,
    sql=f"""with {_LI}, r as (select * exclude (l_quantity) from li union all select * exclude (l_quantity) from li where l_returnflag = 'R')
    select (select count(*) from r) as rows, 11 as columns, (select sum(n - 1)::bigint from (select count(*) as n from r group by {", ".join("q" if c == "l_quantity" else c for c in _LCOLS)})) as duplicate_rows,
    (select count(*) from r where q is null) as null_rows, 8 as numeric_columns, 2 as categorical_columns""",
)
def table_summary(spark: SparkSession, root: str) -> DataFrame:
    """Whole line items, of which the returned ones appear twice."""
    rows = items(spark, root)
    return pr.summary(rows.union(rows.where("l_returnflag = 'R'")))


@query("unique_values", 30, sql=f"with {_LI} select distinct q as l_quantity from li where q is not null")
def unique_values(spark: SparkSession, root: str) -> DataFrame:
    return pr.unique_values(items(spark, root), "l_quantity")


