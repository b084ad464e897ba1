"""Queries over ranking, relevance, faithfulness, hallucination, latency and benchmark comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorespan.operators import (
    benchmark as b,
    faithfulness as fa,
    hallucination as ha,
    latency as la,
    rankeval as re_,
    relevance as rel,
    retrieve as r,
    skew,
)
from lorespan.plans import sqltext as q
from lorespan.plans.registry import query
from lorespan.plans.retrieval import _COS, _PAIRS, _RETRIEVE, _TEXT, _vectors, corpus_chunks, questions, retrieved
from lorespan.session import scratch_path
from lorespan.sources.tables import table

# Ranking: every vector asks for its ten nearest, relevant = same label ------------------------------------------


def _judged(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Judged runs, and the number of relevant vectors of every query."""
    queries, corpus = _vectors(spark, root)
    hits = r.search(queries, corpus, 10, exclude_self=True, plan="blocks")
    judged = hits.join(corpus.select("vec_id", "label"), "vec_id").join(queries.drop("embedding"), "query_id")
    judged = judged.withColumn("grade", (F.col("label") == F.col("query_label")).cast("double"))
    sizes = corpus.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant"))
    counts = queries.join(sizes, F.col("query_label") == F.col("label")).select("query_id", "relevant")
    return judged, counts


_JUDGED = f"""{_PAIRS}, s as (select query_id, query_label, label, vec_id, round({_COS}, 9) as score from p),
    k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank,
    (label = query_label)::int::double as g from s), j as (select * from k where rank <= 10),
    n as (select a.vec_id as query_id, (select count(*) - 1 from e where e.label = a.label) as relevant from e a),
    h as (select *, sum(g) over (partition by query_id order by rank) as hits,
    row_number() over (partition by query_id order by g desc, rank) as ideal from j),
    m as (select query_id, sum(g) filter (where rank <= 5) as h5, count(*) filter (where rank <= 5) as n5,
    min(rank) filter (where g > 0) as first, sum(g / log2(rank + 1)) filter (where rank <= 5) as dcg,
    sum(g / log2(ideal + 1)) filter (where ideal <= 5) as idcg, sum(case when g > 0 then hits / rank else 0 end) as ap
    from h group by query_id),
    x as (select query_id, h5 / n5 as p, case when relevant = 0 then 0 else h5 / relevant end as rc, m.*, relevant
    from m join n using (query_id)),
    metrics as (select query_id, round(p, 4) as precision, round(rc, 4) as recall,
    case when p + rc = 0 then 0 else round(2 * p * rc / (p + rc), 4) end as f1,
    case when h5 > 0 then 1.0 else 0.0 end::double as hit_rate, round(coalesce(1 / first, 0), 4) as reciprocal_rank,
    round(dcg, 4) as dcg, case when idcg = 0 then 0 else round(dcg / idcg, 4) end as ndcg,
    case when relevant = 0 then 0 else round(ap / relevant, 4) end as average_precision from x)"""


def _metrics(spark: SparkSession, root: str) -> DataFrame:
    judged, counts = _judged(spark, root)
    return re_.ranking_metrics(judged, counts, 5)


@query("ranking_metrics", 181, 182, 183, 184, 185, 186, 187, sql=f"with {_JUDGED} select * from metrics")
def ranking_metrics(spark: SparkSession, root: str) -> DataFrame:
    return _metrics(spark, root)


@query(
    "mean_ranking_metrics",
    184,
    187,
    sql=f"""with {_JUDGED} select count(*) as queries, round(avg(precision), 4) as precision, round(avg(recall), 4)
    as recall, round(avg(f1), 4) as f1, round(avg(hit_rate), 4) as hit_rate, round(avg(ndcg), 4) as ndcg,
    round(avg(reciprocal_rank), 4) as mrr, round(avg(average_precision), 4) as map from metrics""",
)
def mean_ranking_metrics(spark: SparkSession, root: str) -> DataFrame:
    return re_.mean_metrics(_metrics(spark, root))


_HISTORY = "m as (select event_type as metric, value / 490.02 as score from events)"


def _history(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        F.col("event_type").alias("metric"), (F.col("value") / 490.02).alias("score")
    )


@query(
    "metric_statistics",
    196,
    sql=f"""with {_HISTORY} select metric, count(*) as metrics, round(avg(score), 4) as average,
    round(min(score), 4) as minimum, round(max(score), 4) as maximum, round(median(score), 4) as median,
    round(stddev_pop(score), 4) as std from m group by metric""",
)
def metric_statistics(spark: SparkSession, root: str) -> DataFrame:
    return re_.metric_statistics(_history(spark, root))


@query("find_metric", 197, sql=f"with {_HISTORY} select * from m where metric = 'click'")
def find_metric(spark: SparkSession, root: str) -> DataFrame:
    return re_.find_metric(_history(spark, root), "click")


# Classification and regression ----------------------------------------------------------------------------------

_LABELLED = "l as (select quality, (n_chars >= 400)::int as guess, n_chars from labels join documents using (doc_id))"


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "n_chars")
    return table(spark, root, "labels").join(docs, "doc_id").withColumn("guess", (F.col("n_chars") >= 400).cast("int"))


@query(
    "classification",
    188,
    189,
    sql=f"""with {_LABELLED}, c as (select count(*) filter (where quality = 1 and guess = 1) as tp,
    count(*) filter (where quality = 0 and guess = 1) as fp, count(*) filter (where quality = 1 and guess = 0) as fn,
    count(*) filter (where quality = 0 and guess = 0) as tn from l),
    p as (select *, tp / (tp + fp) as pr, tp / (tp + fn) as rc from c)
    select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 4) as accuracy, round(pr, 4) as precision,
    round(rc, 4) as recall, coalesce(round(tn / nullif(tn + fp, 0), 4), 0) as specificity,
    round(2 * pr * rc / (pr + rc), 4) as f1 from p""",
)
def classification(spark: SparkSession, root: str) -> DataFrame:
    return re_.classification(_labelled(spark, root), "quality", "guess")


@query(
    "regression_errors",
    190,
    sql="""with d as (select l_returnflag, l_extendedprice - l_quantity * 1500 as d from lineitem)
    select l_returnflag, round(avg(d * d), 4) as mse, round(sqrt(avg(d * d)), 4) as rmse, round(avg(abs(d)), 4) as mae
    from d group by l_returnflag""",
)
def regression_errors(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return re_.regression_errors(items, "l_extendedprice", "guess", ["l_returnflag"])


# Text pairs: every message with the message before it ------------------------------------------------------------

_TURNS = """t as (select *, lag(text) over (partition by conv_id order by turn) as before from conversations),
    pairs as (select conv_id, turn, before as reference, text as candidate from t where before is not null)"""


def _turn_pairs(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "conversations")
    paired = skew.previous_value(turns, ["conv_id"], ["turn"], skew.width_bucket("turn"), "text", "reference")
    return paired.where(F.col("reference").isNotNull()).select(
        "conv_id", "turn", "reference", F.col("text").alias("candidate")
    )


_A, _B = f"list_distinct({q.tokens('reference')})", f"list_distinct({q.tokens('candidate')})"


@query(
    "text_overlap",
    191,
    192,
    193,
    sql=f"""with {_TURNS} select conv_id, turn,
    case when {q.normalize("reference")} = {q.normalize("candidate")} then 1.0 else 0.0 end::double as exact_match,
    case when len({_A}) = 0 then 0 else round(len(list_intersect({_A}, {_B})) / len({_A}), 4) end as overlap,
    case when len({_A}) + len({_B}) = 0 then 0 else round(len(list_intersect({_A}, {_B}))
    / len(list_distinct(list_concat({_A}, {_B}))), 4) end as jaccard from pairs""",
)
def text_overlap(spark: SparkSession, root: str) -> DataFrame:
    x, y = F.col("reference"), F.col("candidate")
    return _turn_pairs(spark, root).select(
        "conv_id",
        "turn",
        re_.exact_match(x, y).alias("exact_match"),
        F.round(re_.overlap_score(x, y), 4).alias("overlap"),
        F.round(re_.jaccard_similarity(x, y), 4).alias("jaccard"),
    )


def _grams_sql(sizes: tuple[int, ...]) -> str:
    """Clipped matches per pair and n by explode, count and join: a different route than the engine's."""
    w = lambda c, n: (
        f"unnest(list_transform(range(1, len({q.tokens(c)}) - {n - 2}), "
        f"lambda i: array_to_string(({q.tokens(c)})[i:i + {n - 1}], ' ')))"
    )
    parts = [_TURNS]
    for n in sizes:
        parts.append(
            f"""r{n} as (select conv_id, turn, g, count(*) as c from (select conv_id, turn, {w("reference", n)} as g
            from pairs) group by all), c{n} as (select conv_id, turn, g, count(*) as c from (select conv_id, turn,
            {w("candidate", n)} as g from pairs) group by all),
            m{n} as (select conv_id, turn, sum(least(r{n}.c, c{n}.c)) as m from r{n} join c{n} using (conv_id, turn, g)
            group by all)"""
        )
    return "with " + ", ".join(parts)


_LEN = lambda c, n: f"greatest(len({q.tokens(c)}) - {n - 1}, 0)"


@query(
    "rouge",
    195,
    sql=f"""{_grams_sql((1, 2))} select conv_id, turn, """
    + ", ".join(
        f"coalesce(round(2 * (m{n}.m / {_LEN('candidate', n)}) * (m{n}.m / {_LEN('reference', n)}) / "
        f"(m{n}.m / {_LEN('candidate', n)} + m{n}.m / {_LEN('reference', n)}), 4), 0) as rouge{n}"
        for n in (1, 2)
    )
    + " from pairs left join m1 using (conv_id, turn) left join m2 using (conv_id, turn)",
)
def rouge(spark: SparkSession, root: str) -> DataFrame:
    return re_.rouge(_turn_pairs(spark, root), "reference", "candidate", ["conv_id", "turn"])


@query(
    "rouge_l",
    195,
    sql=f"""with recursive {_TURNS.removeprefix("with ")}, w as (select conv_id, turn, {q.tokens("reference")} as r, {q.tokens("candidate")} as c from pairs),
    d as (select conv_id, turn, r, c, 0 as i, list_transform(range(0, len(r) + 1), lambda j: 0::bigint) as cells from w
    union all select conv_id, turn, r, c, i + 1, list_reduce(list_transform(range(1, len(r) + 1), lambda j: [j]),
    lambda acc, x: list_append(acc, greatest(acc[len(acc)], cells[x[1] + 1], cells[x[1]] + (r[x[1]] = c[i + 1])::bigint)), [0::bigint])
    from d where i < len(c)),
    n as (select conv_id, turn, len(r) as nr, len(c) as nc, cells[len(cells)] as common from d where i = len(c))
    select conv_id, turn, common, coalesce(round(2 * (common / nc) * (common / nr) / nullif(common / nc + common / nr, 0), 4), 0) as rougeL from n""",
)
def rouge_l(spark: SparkSession, root: str) -> DataFrame:
    return re_.rouge_l(_turn_pairs(spark, root), "reference", "candidate", ["conv_id", "turn"])


@query(
    "bleu",
    194,
    sql=f"""{_grams_sql((1, 2, 3, 4))}, s as (select """
    + ", ".join(f"(select sum(m) from m{n}) as m{n}, (select sum({_LEN('candidate', n)}) from pairs) as c{n}" for n in (1, 2, 3, 4))
    + f""", (select sum({_LEN("reference", 1)}) from pairs) as r)
    select round(exp((ln(m1 / c1) + ln(m2 / c2) + ln(m3 / c3) + ln(m4 / c4)) / 4 + least(0, 1 - r / c1)), 4) as bleu
    from s""",
)
def bleu(spark: SparkSession, root: str) -> DataFrame:
    return re_.bleu(_turn_pairs(spark, root), "reference", "candidate")


# Relevance of the retrieved chunks -------------------------------------------------------------------------------


def _scored(spark: SparkSession, root: str) -> DataFrame:
    pairs = retrieved(spark, root)
    return rel.score_pairs(pairs, semantic=F.col("score"))


_OV = f"""case when len(list_distinct({q.tokens("query_text")})) = 0 then 0 else
    len(list_intersect(list_distinct({q.tokens("query_text")}), {q.tokens("text")}))
    / len(list_distinct({q.tokens("query_text")})) end"""
# White space is Unicode's, as in the query; RE2's is that of ASCII without the vertical tab.
_SPACED = ", ".join(
    rf"{t} as (select * replace (regexp_replace(text, '[\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g') as text) from {t})"
    for t in ("documents", "benchmark")
)
_HITS = f"with {_SPACED}, {_RETRIEVE.removeprefix('with ')}".replace("hits as (select * from z where n <= 5)", "hits as (select z.*, b.text as query_text from z "
    "join benchmark b on b.item_id = query_id where n <= 5)")
_SCORED = f"""{_HITS}, a as (select query_id, vec_id, text, query_text, round({_OV}, 4) as keyword_score,
    {q.rounded("score", 4)} as semantic_score from hits), scored as (select *, round(0.4::double * keyword_score
    + 0.6::double * semantic_score, 4) as relevance from a)"""
_EVAL = f"""ev as (select query_id, {q.exact_mean("relevance", 4)} as score, {q.exact_mean("keyword_score", 4)} as keyword_score,
    {q.exact_mean("semantic_score", 4)} as semantic_score, count(*) as document_count,
    count(*) filter (where relevance >= 0.75) as relevant_documents from scored group by query_id)"""


@query(
    "document_relevance",
    198,
    199,
    201,
    sql=f"""{_SCORED} select query_id, vec_id, keyword_score, semantic_score, relevance, relevance >= 0.75 as relevant,
    row_number() over (partition by query_id order by relevance desc, vec_id) as rank from scored""",
)
def document_relevance(spark: SparkSession, root: str) -> DataFrame:
    good, bad = rel.split_relevant(_scored(spark, root))
    return rel.rank_documents(good.unionByName(bad), ["query_id"], "vec_id").select(
        "query_id", "vec_id", "keyword_score", "semantic_score", "relevance", "relevant", "rank"
    )


@query("relevance_evaluation", 202, 200, sql=f"{_SCORED}, {_EVAL} select * from ev")
def relevance_evaluation(spark: SparkSession, root: str) -> DataFrame:
    return rel.evaluate(_scored(spark, root))


@query(
    "relevance_query_summary",
    203,
    sql=f"""{_HITS} select query_id, max(len({q.tokens("query_text")})) as query_tokens, count(*) as documents,
    round(avg(len({q.tokens("text")})), 2) as average_document_tokens from hits group by query_id""",
)
def relevance_query_summary(spark: SparkSession, root: str) -> DataFrame:
    return rel.query_summary(retrieved(spark, root))


def _two_systems(spark: SparkSession, root: str) -> DataFrame:
    """Plain vector search and the reranked retrieval, scored by keywords only."""
    qs, cs = questions(spark, root), corpus_chunks(spark, root)
    texts = qs.select("query_id", F.col("text").alias("query_text"))
    plain = r.search(qs, cs, 5).join(cs.select("vec_id", "text"), "vec_id").join(texts, "query_id")
    cols = ["query_id", "vec_id", "query_text", "text"]
    both = plain.select(F.lit("vector").alias("system"), *cols).unionByName(
        r.retrieve(qs, cs, 5).select(F.lit("reranked").alias("system"), *cols)
    )
    return rel.score_pairs(both)


@query(
    "compare_retrievers",
    204,
    sql=f"""{_HITS}, v as (select 'vector' as system, query_id, text, query_text from k where rank <= 5 union all
    select 'reranked', query_id, text, query_text from hits),
    w as (select system, query_id, round({_OV}, 4) as keyword_score from v),
    scored as (select *, round(0.4::double * keyword_score, 4) as relevance from w)
    select system, query_id, {q.exact_mean("relevance", 4)} as score, {q.exact_mean("keyword_score", 4)} as keyword_score,
    0.0::double as semantic_score, count(*) as document_count,
    count(*) filter (where relevance >= 0.75) as relevant_documents from scored group by system, query_id""",
)
def compare_retrievers(spark: SparkSession, root: str) -> DataFrame:
    return rel.evaluate(_two_systems(spark, root), ["system", "query_id"])


@query(
    "relevance_distribution",
    205,
    sql=f"""{_SCORED}, {_EVAL} select count(*) filter (where score >= 0.8) as high,
    count(*) filter (where score >= 0.5 and score < 0.8) as medium, count(*) filter (where score < 0.5) as low from ev""",
)
def relevance_distribution(spark: SparkSession, root: str) -> DataFrame:
    return rel.distribution(rel.evaluate(_scored(spark, root)))


@query(
    "relevance_statistics",
    206,
    sql=f"""{_SCORED}, {_EVAL} select count(*) as evaluations, {q.exact_mean("score", 4)} as average_score,
    min(score) as minimum_score, max(score) as maximum_score, arg_min(query_id, (-score, query_id)) as best_query,
    arg_min(query_id, (score, query_id)) as worst_query from ev""",
)
def relevance_statistics(spark: SparkSession, root: str) -> DataFrame:
    return rel.statistics(rel.evaluate(_scored(spark, root)))


# Answers: every assistant turn with the ten messages before it as context -----------------------------------------


def answers(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "conversations")
    numbered = skew.position(turns, ["conv_id"], ["turn"], skew.width_bucket("turn"))
    with_context = skew.previous_rows(numbered, ["conv_id"], "pos", 10, F.col("text"), "context")
    return with_context.where("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("answer"), "context"
    )


_ANSWERS = """w as (select *, coalesce(list(text) over (partition by conv_id order by turn rows between 10 preceding
    and 1 preceding), []) as context from conversations),
    answers as (select conv_id, turn, text as answer, context from w where role = 'assistant')"""
_CLAIMS = f"""{_ANSWERS}, cl as (select conv_id, turn, list_filter({q.sentences(q.collapse("answer"))},
    lambda s: {q.n_words("s")} >= 5) as cs, flatten(list_transform(context,
    lambda c: {q.sentences(q.collapse("c"))})) as ss from answers),
    c0 as (select conv_id, turn, unnest(cs) as claim, generate_subscripts(cs, 1) as i from cl),
    c1 as (select conv_id, turn, claim, row_number() over (partition by conv_id, turn order by min(i)) - 1
    as claim_index from c0 group by conv_id, turn, claim),
    s1 as (select conv_id, turn, unnest(ss) as s, generate_subscripts(ss, 1) as j from cl),
    x as (select c1.*, s, j, len(list_intersect(list_distinct({q.words("claim")}), {q.words("s")}))
    / len(list_distinct({q.words("claim")})) as o from c1 left join s1 using (conv_id, turn)),
    verified as (select conv_id, turn, claim_index, claim, coalesce(max(o), 0) >= 0.75 as supported,
    round(coalesce(max(o), 0), 4) as score, coalesce(arg_min(s, (-o, j)) filter (where o > 0), '') as evidence
    from x group by conv_id, turn, claim_index, claim)"""


@query("verify_claims", 209, 207, 208, 210, sql=f"with {_CLAIMS} select * from verified")
def verify_claims(spark: SparkSession, root: str) -> DataFrame:
    return fa.verify_claims(answers(spark, root), ["conv_id", "turn"])


_FAITH = f"""{_CLAIMS}, n as (select conv_id, turn, len(ss) as n from cl),
    g as (select conv_id, turn, count(*) as total, count(*) filter (where supported) as sup, sum(score) as sc,
    count(distinct evidence) filter (where supported) as ev from verified group by conv_id, turn),
    cw as (select conv_id, turn, list_distinct({q.words(q.collapse("array_to_string(context, ' ')"))}) as c,
    {q.words(q.collapse("answer"))} as a from answers),
    faith as (select conv_id, turn, round(coalesce(sup / total, 0), 4) as faithfulness,
    {q.rounded("coalesce(round(sc, 4) / total, 0)", 4)} as groundedness, case when n = 0 then 0 else round(coalesce(ev, 0) / n, 4) end
    as evidence_score, coalesce(sup, 0) as supported_claims, coalesce(total - sup, 0) as unsupported_claims,
    coalesce(total, 0) as total_claims, round(coalesce((total - sup) / total, 0), 4) as unsupported_ratio,
    case when len(c) = 0 then 0 else round(len(list_intersect(c, a)) / len(c), 4) end as completeness
    from n join cw using (conv_id, turn) left join g using (conv_id, turn))"""


@query("faithfulness", 215, 211, 212, 213, 214, sql=f"with {_FAITH} select * from faith")
def faithfulness(spark: SparkSession, root: str) -> DataFrame:
    return fa.evaluate(answers(spark, root), ["conv_id", "turn"])


@query(
    "faithfulness_statistics",
    216,
    sql=f"""with {_FAITH} select count(*) as evaluations, round(avg(faithfulness), 4) as average_score,
    round(avg(groundedness), 4) as average_groundedness, round(avg(evidence_score), 4) as average_evidence_score,
    sum(supported_claims)::bigint as supported_claims, sum(unsupported_claims)::bigint as unsupported_claims,
    arg_min(conv_id, (-faithfulness, conv_id, turn)) as best_conv_id,
    arg_min(turn, (-faithfulness, conv_id, turn)) as best_turn,
    arg_min(conv_id, (faithfulness, conv_id, turn)) as worst_conv_id,
    arg_min(turn, (faithfulness, conv_id, turn)) as worst_turn from faith""",
)
def faithfulness_statistics(spark: SparkSession, root: str) -> DataFrame:
    keys = ["conv_id", "turn"]
    return fa.statistics(fa.evaluate(answers(spark, root), keys), keys)


_NUM = r"\b\d+(?:\.\d+)?\b"
_DATE = ha.DATE[1:-1]
_ENT = ha.ENTITY[1:-1]
_NEG = "['not', 'never', 'none', 'no', 'without', 'cannot']"
_HALL = f"""{_ANSWERS}, r as (select conv_id, turn, answer, array_to_string(context, ' ') as raw,
    {q.collapse("array_to_string(context, ' ')")} as ctx, {q.sentences(q.collapse("answer"))} as claims from answers),
    d as (select conv_id, turn, claims, list_filter(claims, lambda c: not contains(ctx, c)) as un,
    list_filter(claims, lambda c: contains(ctx, c) and
    list_has_any({q.words("c")}, {_NEG}) <> list_has_any({q.words("ctx")}, {_NEG})) as con,
    list_distinct(regexp_extract_all(answer, '{_NUM}')) as an,
    list_distinct(regexp_extract_all(ctx, '{_NUM}')) as cn,
    list_distinct(regexp_extract_all(lower(answer), '{_DATE}')) as ad,
    list_distinct(regexp_extract_all(ctx, '{_DATE}')) as cd,
    list_distinct(list_transform(regexp_extract_all(answer, '{_ENT}'), lambda x: lower(x))) as ae,
    list_distinct(list_transform(regexp_extract_all(raw, '{_ENT}'), lambda x: lower(x))) as ce from r),
    f as (select *, list_filter(an, lambda x: not list_contains(cn, x)) as nn,
    list_filter(ad, lambda x: not list_contains(cd, x)) as nd,
    list_filter(ae, lambda x: not list_contains(ce, x)) as ne from d),
    h1 as (select conv_id, turn, len(claims) as claims, len(un) as unsupported_claims, len(ne) as entity_errors,
    len(nn) as numeric_errors, len(nd) as date_errors, len(con) as contradictions,
    case when len(ae) = 0 then 1 else round((len(ae) - len(ne)) / len(ae), 4) end as entity_coverage,
    case when len(an) = 0 then 1 else round((len(an) - len(nn)) / len(an), 4) end as numeric_coverage,
    case when len(ad) = 0 then 1 else round((len(ad) - len(nd)) / len(ad), 4) end as date_coverage,
    round(greatest(0, 1 - (len(un) + len(ne) + len(nn) + len(nd) + len(con)) / greatest(1, len(claims))), 4) as score,
    case when len(claims) = 0 then 1 else round((len(claims) - len(un)) / len(claims), 4) end as evidence_coverage
    from f), h2 as (select *, round((entity_coverage + numeric_coverage + date_coverage) / 3, 4) as factual_consistency
    from h1), hall as (select *, round((score + factual_consistency + evidence_coverage) / 3, 4) as confidence from h2)"""


@query(
    "hallucination_findings",
    217,
    218,
    219,
    220,
    221,
    222,
    sql=f"""with {_HALL} select conv_id, turn, claims, un as unsupported, list_sort(an) as answer_numbers,
    list_sort(nn) as new_numbers, list_sort(nd) as new_dates, list_sort(ne) as new_entities, con as contradictions
    from f""",
)
def hallucination_findings(spark: SparkSession, root: str) -> DataFrame:
    found = ha.detect(answers(spark, root), ["conv_id", "turn"])
    return found.withColumn("answer_numbers", F.sort_array("answer_numbers")).drop("answer_dates", "answer_entities")


@query("hallucination", 225, 223, 224, sql=f"with {_HALL} select * from hall")
def hallucination(spark: SparkSession, root: str) -> DataFrame:
    keys = ["conv_id", "turn"]
    return ha.evaluate(ha.detect(answers(spark, root), keys), keys)


def _ENDS(keys: tuple[str, str], best: str, worst: str) -> str:  # noqa: N802
    """Keys of the best and the worst row; of equal ones, the smallest."""
    at = lambda k, s: f"arg_min({k}, {{'s': {s}, 'a': {keys[0]}, 'b': {keys[1]}}})"
    return ", ".join(f"{at(k, s)} as {name}_{k}" for name, s in (("best", best), ("worst", worst)) for k in keys)


@query(
    "hallucination_statistics",
    225,
    sql=f"""with {_HALL} select count(*) as evaluations, round(avg(score), 4) as average_score,
    sum(entity_errors)::bigint as entity_errors, sum(numeric_errors)::bigint as numeric_errors,
    sum(date_errors)::bigint as date_errors, sum(unsupported_claims)::bigint as unsupported_claims,
    sum(contradictions)::bigint as contradictions, min(score) as minimum_score, max(score) as maximum_score,
    {_ENDS(("conv_id", "turn"), "-score", "score")} from hall""",
)
def hallucination_statistics(spark: SparkSession, root: str) -> DataFrame:
    keys = ["conv_id", "turn"]
    return ha.statistics(ha.evaluate(ha.detect(answers(spark, root), keys), keys), keys)


# Latency: a request is a user's day, its stages are the event types ------------------------------------------------

STAGES = ("signup", "error", "click", "view", "purchase")


def requests(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("day", F.to_date("ts"))
    # Decimal sums: a total on the bound of a grade must not depend on the order of the events.
    spent = F.sum(F.col("value").cast("decimal(28,9)")).cast("double")
    return e.groupBy("user_id", "day").pivot("event_type", list(STAGES)).agg(spent)


_REQ = "q as (select user_id, ts::date as day, " + ", ".join(
    f"coalesce(sum(value::decimal(28, 9)) filter (where event_type = '{s}')::double, 0) as {s}" for s in STAGES
) + " from events group by user_id, ts::date), t as (select *, " + " + ".join(STAGES) + " as ms from q)"
_GRADE = "case when ms <= 100 then 'A+' when ms <= 250 then 'A' when ms <= 500 then 'B' when ms <= 1000 then 'C' when ms <= 2000 then 'D' else 'F' end"
_EXT = lambda f: f"case {f}({', '.join(STAGES)}) " + " ".join(f"when {s} then '{s}'" for s in STAGES) + " end"
# A request without any time has no throughput; its shares are taken of 1e-9 ms.
_LAT = f"""{_REQ}, l as (select user_id, day, {q.rounded("ms", 4)} as total_latency,
    case when ms <= 0 then 0 else {q.rounded("1 / (ms / 1000)", 2)} end as queries_per_second,
    case when ms <= 0 then 0 else {q.rounded("10 / (ms / 1000)", 2)} end as tokens_per_second,
    {", ".join(f"{q.rounded(f'{s} / greatest(ms, 1e-9) * 100', 2)} as {s}_percent" for s in STAGES)},
    {_EXT("greatest")} as slowest_stage, {_EXT("least")} as fastest_stage, {_GRADE} as grade,
    ms >= 1000 as high_latency, ms >= 500 as warning_latency from t)"""


def _evaluated(spark: SparkSession, root: str) -> DataFrame:
    return la.evaluate(requests(spark, root), ["user_id", "day"], STAGES, tokens=F.lit(10))


@query("latency_requests", 226, 228, 229, 230, 231, 232, 233, sql=f"with {_LAT} select * from l")
def latency_requests(spark: SparkSession, root: str) -> DataFrame:
    return _evaluated(spark, root)


@query(
    "latency_statistics",
    234,
    sql=f"""with {_LAT} select count(*) as evaluations, {q.exact_mean("total_latency", 3)} as average_latency,
    min(total_latency) as minimum_latency, max(total_latency) as maximum_latency,
    {q.exact_mean("queries_per_second", 2)} as average_qps, {q.exact_mean("tokens_per_second", 2)} as average_tokens_per_second,
    count(*) filter (where high_latency) as high, count(*) filter (where warning_latency) as warning,
    {_ENDS(("user_id", "day"), "total_latency", "-total_latency")} from l""",
)
def latency_statistics(spark: SparkSession, root: str) -> DataFrame:
    return la.statistics(_evaluated(spark, root), keys=["user_id", "day"])


@query(
    "stage_statistics",
    227,
    sql=f"""with {_REQ}, u as (unpivot (select user_id, day, {", ".join(STAGES)} from q) on {", ".join(STAGES)}
    into name stage value ms), p as (select * from u where exists (select 1 from events e where e.user_id = u.user_id
    and e.ts::date = u.day and e.event_type = u.stage))
    select stage, count(*) as samples, round(avg(ms), 3) as average, round(min(ms), 4) as minimum, round(max(ms), 4) as maximum,
    round(quantile_cont(ms, 0.5), 4) as p50, round(quantile_cont(ms, 0.95), 4) as p95,
    round(quantile_cont(ms, 0.99), 4) as p99 from p group by stage""",
)
def stage_statistics(spark: SparkSession, root: str) -> DataFrame:
    stats = la.stage_statistics(la.unpivot_stages(requests(spark, root), ["user_id", "day"], STAGES))
    return stats.withColumn("minimum", F.round("minimum", 4)).withColumn("maximum", F.round("maximum", 4))


# Benchmark: systems are event types, queries are events -------------------------------------------------------------

_M = q.exact_mean("overall_score", 4)
_ML = q.exact_mean("latency_ms", 2)
_SC = f"""sc as (select event_type as system, user_id as retriever, event_id as query_id, value / 490.02 as retrieval_score,
    json_extract(props, '$.k')::int / 100 as relevance_score, value as latency_ms, ts::date::varchar as run_id
    from events), res as (select *, {q.rounded("(retrieval_score + relevance_score) / 2", 4)} as overall_score from sc)"""


def scores(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    keys = [F.col("event_type").alias("system"), F.col("event_id").alias("query_id")]
    k = F.from_json("props", "k int")["k"]
    retrieval = e.select(*keys, (F.col("value") / 490.02).alias("retrieval_score"), F.col("value").alias("latency_ms"))
    relevance = e.select(
        *keys,
        (k / 100).alias("relevance_score"),
        F.col("user_id").alias("retriever"),
        F.to_date("ts").cast("string").alias("run_id"),
    )
    return b.overall(b.join_scores([retrieval, relevance]))


@query(
    "benchmark_scores",
    235,
    242,
    sql=f"with {_SC} select system, query_id, round(retrieval_score, 6) as retrieval_score, round(relevance_score, 6) "
    "as relevance_score, latency_ms, overall_score from res",
)
def benchmark_scores(spark: SparkSession, root: str) -> DataFrame:
    rows = b.report(scores(spark, root))[1]
    return rows.withColumn("retrieval_score", F.round("retrieval_score", 6)).withColumn(
        "relevance_score", F.round("relevance_score", 6)
    )


@query(
    "stored_runs",
    241,
    sql=f"""with {_SC} select v.run_id, query_id, overall_score from res cross join (values ('first'), ('second')) v(run_id)""",
)
def stored_runs(spark: SparkSession, root: str) -> DataFrame:
    """Two runs stored one after the other, and read back as one history."""
    rows = b.report(scores(spark, root))[1].select("query_id", "overall_score")
    path = scratch_path(spark, "runs")
    for run in ("first", "second"):
        b.append_run(rows, path, run)
    return b.read_runs(spark, path).select("run_id", "query_id", "overall_score")


@query(
    "benchmark_report",
    242,
    sql=f"""with {_SC} select count(*) as queries, {_M} as average_score,
    {_ML} as average_latency, max(overall_score) as best_score, min(overall_score) as worst_score
    from res""",
)
def benchmark_report(spark: SparkSession, root: str) -> DataFrame:
    return b.report(scores(spark, root))[0]


_PER = f"""per as (select system, count(*) as total_queries, {_M} as average_score,
    {_ML} as average_latency, min(overall_score) as minimum_score, max(overall_score)
    as maximum_score, round(avg((overall_score >= 0.75)::int), 4) as success_rate from res group by system)"""


@query(
    "benchmark_ranking",
    240,
    236,
    237,
    sql=f"with {_SC}, {_PER} select *, rank() over (order by average_score desc) as position from per",
)
def benchmark_ranking(spark: SparkSession, root: str) -> DataFrame:
    return b.ranking(b.statistics(scores(spark, root), ["system"]))


@query(
    "benchmark_runtime",
    238,
    sql=f"""with {_SC} select system, count(*) as queries, round(sum(latency_ms) / 1000, 3) as total_runtime_seconds,
    round(count(*) / (sum(latency_ms) / 1000), 2) as throughput_qps from res group by system""",
)
def benchmark_runtime(spark: SparkSession, root: str) -> DataFrame:
    return b.runtime_statistics(scores(spark, root), ["system"])


@query(
    "benchmark_compare",
    239,
    sql=f"""with {_SC} select system, retriever, grouping(system, retriever) as level, count(*) as total_queries,
    {_M} as average_score, {_ML} as average_latency from res
    group by cube (system, retriever)""",
)
def benchmark_compare(spark: SparkSession, root: str) -> DataFrame:
    return b.compare(scores(spark, root), ["system", "retriever"])


@query(
    "benchmark_history",
    241,
    sql=f"""with {_SC}, m as (select run_id, system, {_M} as average_score from res group by all)
    select *, round(average_score - lag(average_score) over (partition by system order by run_id), 4) as change from m""",
)
def benchmark_history(spark: SparkSession, root: str) -> DataFrame:
    return b.history(scores(spark, root))


@query("benchmark_valid", 53, sql="select bool_and(text <> '') as valid, count(*) as queries from benchmark")
def benchmark_valid(spark: SparkSession, root: str) -> DataFrame:
    return b.validate_dataset(table(spark, root, "benchmark").withColumnRenamed("text", "query"))
