"""Queries over filters, projections, files and exports."""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorespan.functions import text as t
from lorespan.operators import metricstore as ms, predicates as p, profile as pr
from lorespan.plans import sqltext as q
from lorespan.plans.analytics import samples
from lorespan.plans.registry import query
from lorespan.plans.retrieval import _RETRIEVE, retrieved
from lorespan.session import scratch_path
from lorespan.sources import export as ex, files as fi
from lorespan.sources.tables import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@query("preview_rows", 23, sql="select * from orders order by o_orderkey limit 5")
def preview_rows(spark: SparkSession, root: str) -> DataFrame:
    return p.preview(table(spark, root, "orders"), ["o_orderkey"])


@query("tail_rows", 24, sql="select * from orders order by o_orderkey desc limit 5")
def tail_rows(spark: SparkSession, root: str) -> DataFrame:
    return p.tail(table(spark, root, "orders"), ["o_orderkey"])


@query("preview_columns", 25, sql="select o_orderkey, o_orderstatus from orders order by o_orderkey limit 7")
def preview_columns(spark: SparkSession, root: str) -> DataFrame:
    return p.preview(p.select_columns(table(spark, root, "orders"), ["o_orderkey", "o_orderstatus"]), ["o_orderkey"], 7)


@query("row_at", 27, sql="select * from orders order by o_orderdate, o_orderkey limit 1 offset 41")
def row_at(spark: SparkSession, root: str) -> DataFrame:
    return p.row_at(table(spark, root, "orders"), ["o_orderdate", "o_orderkey"], 41)


@query("filter_rows", 28, sql="select o_orderkey, o_totalprice from orders where o_orderpriority = '2-HIGH'")
def filter_rows(spark: SparkSession, root: str) -> DataFrame:
    return p.filter_rows(table(spark, root, "orders"), "o_orderpriority", "2-HIGH").select("o_orderkey", "o_totalprice")


@query(
    "search_rows",
    29,
    sql="select * from customer where contains(lower(c_name), 'ing') or contains(lower(c_mktsegment), 'ing')",
)
def search_rows(spark: SparkSession, root: str) -> DataFrame:
    return p.search_any(table(spark, root, "customer"), "ING")


@query("sample_rows", 31)
def sample_rows(spark: SparkSession, root: str) -> DataFrame:
    return pr.sample(table(spark, root, "orders"), 5, 42, "o_orderkey")


@query("search_documents", 34, sql="select doc_id from documents where contains(lower(text), 'tion the')")
def search_documents(spark: SparkSession, root: str) -> DataFrame:
    return p.search_text(table(spark, root, "documents"), "TION the").select("doc_id")


@query("starts_ends", 35, sql="select doc_id from documents where starts_with(text, 'The') and suffix(text, '.')")
def starts_ends(spark: SparkSession, root: str) -> DataFrame:
    return p.starts_or_ends(table(spark, root, "documents"), "The", ".").select("doc_id")


# Frequent words become the phrases that the detector looks for.
_PHRASES = ((" the the ", " Ignore Previous "), (" of the ", " bypass "), (" and the ", " System Prompt "))


@query(
    "injection_report",
    47,
    sql="""with x as (select source, lower(replace(replace(replace(text, ' the the ', ' Ignore Previous '), ' of the ',
    ' bypass '), ' and the ', ' System Prompt ')) as x from documents) select source, count(*) as texts,
    count(*) filter (where """
    + " or ".join(f"contains(x, '{ph}')" for ph in p.INJECTION_PHRASES)
    + ") as suspicious from x group by source",
)
def injection_report(spark: SparkSession, root: str) -> DataFrame:
    text = F.col("text")
    for old, new in _PHRASES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return p.injection_report(table(spark, root, "documents").withColumn("text", text), ["source"])


@query(
    "text_previews",
    49,
    sql="select doc_id, case when length(text) <= 100 then text else substring(text, 1, 100) || '...' end as short, "
    "case when length(text) <= 500 then text else substring(text, 1, 500) || chr(10) || '...' end as long from documents",
)
def text_previews(spark: SparkSession, root: str) -> DataFrame:
    x = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id", t.preview(x, 100).alias("short"), t.preview(x, 500, "\n...").alias("long")
    )


@query("fetch_page", 50, sql="select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25 offset 50")
def fetch_page(spark: SparkSession, root: str) -> DataFrame:
    return p.page(table(spark, root, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 3)


@query("table_counts", 51, sql=" union all ".join(f"select '{n}' as name, count(*) as rows from {n}" for n in TABLES))
def table_counts(spark: SparkSession, root: str) -> DataFrame:
    return p.table_counts({n: table(spark, root, n) for n in TABLES})


_USERS = "u as (select c_custkey, c_name as username, replace(lower(c_name), '#', case when c_acctbal < 0 then ' ' else '' end) || '@mail.example.com' as email from customer)"


@query(
    "validate_users",
    52,
    sql=f"""with {_USERS} select c_custkey, regexp_matches(email, '{p.EMAIL}') as email_valid,
    length(trim(username)) >= 3 as name_valid from u""",
)
def validate_users(spark: SparkSession, root: str) -> DataFrame:
    glue = F.when(F.col("c_acctbal") < 0, " ").otherwise("")
    users = table(spark, root, "customer").select(
        "c_custkey",
        F.col("c_name").alias("username"),
        F.concat(F.replace(F.lower("c_name"), F.lit("#"), glue), F.lit("@mail.example.com")).alias("email"),
    )
    return p.validate_users(users).select("c_custkey", "email_valid", "name_valid")


# Files and exports: written by the tasks below the scratch folder and read back ------------------------------------------


@query("export_csv", 12, 4, sql="select conv_id, turn, role, text from conversations")
def export_csv(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    ex.write_csv(table(spark, root, "conversations"), path)
    return fi.read_csv(spark, path, schema="conv_id long, turn long, role string, text string")


@query("export_json", 13, 16, sql="select conv_id, turn, role, text from conversations")
def export_json(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "json")
    ex.write_json(table(spark, root, "conversations"), path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path)


@query(
    "export_markdown",
    14,
    sql="""select conv_id, turn, '## ' || upper(role[1:1]) || lower(role[2:]) || chr(10) || chr(10) || text || chr(10)
    as block from conversations union all select distinct conv_id, -1, '# Conversation Export' || chr(10) || chr(10)
    || '**Conversation ID:** ' || conv_id || chr(10) || chr(10) || '---' || chr(10) from conversations""",
)
def export_markdown(spark: SparkSession, root: str) -> DataFrame:
    return ex.markdown_blocks(table(spark, root, "conversations"))


@query(
    "export_html",
    15,
    sql="""select conv_id, turn, '<div class="' || role || '">' || chr(10) || '<h3>' || upper(role[1:1]) || lower(role[2:])
    || '</h3>' || chr(10) || '<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>',
    '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>' || chr(10) || '</div>' as block from conversations
    union all select distinct conv_id, -1, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10)
    || '<meta charset="UTF-8">' || chr(10) || '<title>Conversation Export</title>' || chr(10) || '</head>' || chr(10)
    || '<body>' || chr(10) || '<h1>Conversation Export</h1>' || chr(10) || '<p><b>Conversation ID:</b> ' || conv_id
    || '</p>' || chr(10) || '<hr>' from conversations
    union all select distinct conv_id, 4611686018427387904, '</body>' || chr(10) || '</html>' from conversations""",
)
def export_html(spark: SparkSession, root: str) -> DataFrame:
    return ex.html_blocks(table(spark, root, "conversations"))


@query(
    "export_documents",
    14,
    sql="""select conv_id, turn, '## ' || upper(role[1:1]) || lower(role[2:]) || chr(10) || chr(10) || text || chr(10)
    as block from conversations union all select distinct conv_id, -1, '# Conversation Export' || chr(10) || chr(10)
    || '**Conversation ID:** ' || conv_id || chr(10) || chr(10) || '---' || chr(10) from conversations""",
)
def export_documents(spark: SparkSession, root: str) -> DataFrame:
    """Write the documents of all conversations and read their blocks back."""
    path = scratch_path(spark, "markdown")
    ex.write_documents(ex.markdown_blocks(table(spark, root, "conversations")), path)
    return spark.read.schema("conv_id long, turn long, block string").json(path)


@query("export_search_results", 16, sql=f"{_RETRIEVE} select query_id, n as rank, vec_id, source, page, text from hits")
def export_search_results(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "hits")
    ex.write_json(retrieved(spark, root).select("query_id", "rank", "vec_id", "source", "page", "text"), path)
    return spark.read.schema("query_id long, rank long, vec_id string, source string, page long, text string").json(path)


@query(
    "export_nested",
    17,
    sql="""select conv_id, count(*) over (partition by conv_id) as n, turn, role from conversations""",
)
def export_nested(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "conversations").select("conv_id", "turn", "role")
    parents = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "nested")
    ex.write_json(ex.nested(parents, m, "conv_id", "turn"), path)
    kind = "conv_id long, n long, message struct<turn:long,role:string>"
    return spark.read.schema(kind).json(path).select("conv_id", "n", "message.turn", "message.role")


@query("save_embeddings", 18, sql="select vec_id, embedding from embeddings")
def save_embeddings(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    ex.save_embeddings(table(spark, root, "embeddings"), path)
    return ex.load_embeddings(spark, path)


@query("export_collection", 19, 177, sql="select vec_id, label from embeddings union all select vec_id, label from embeddings where label < 3")
def export_collection(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    first, second = scratch_path(spark, "dump"), scratch_path(spark, "dump")
    ex.export_collection(e, first)
    ex.export_collection(e.where("label < 3"), second)
    return ex.import_collection(spark, first, second).select("vec_id", "label")


@query("metric_exposition", 20)
def metric_exposition(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "exposition")
    ex.write_exposition(ms.exposition(samples(spark, root), "event_id"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("storage_statistics", 21)
def storage_statistics(spark: SparkSession, root: str) -> DataFrame:
    return fi.storage_statistics(fi.list_files(spark, root, recursive=True))


@query("list_exports", 22, 9, 11, 36)
def list_exports(spark: SparkSession, root: str) -> DataFrame:
    listed = fi.validate_files(fi.list_files(spark, root, recursive=True), ("parquet",))
    return fi.newest_first(fi.search_files(listed, "E")).select("file_name", "extension", "length", "reject_reason")


@query("file_facts", 8, 10)
def file_facts(spark: SparkSession, root: str) -> DataFrame:
    return fi.file_facts(spark, root, recursive=True).drop("path", "modified_at")


_HIDDEN = "(?is)" + "|".join(f"<{x}\\b[^>]*>.*?</{x}\\s*>" for x in ("script", "style", "noscript", "template")) + "|<!--.*?-->"


def _entities_sql() -> str:
    """``ent``: one row of maps that hold the character references of HTML, as ``html.unescape`` has them."""
    literal = lambda d: "map([" + ", ".join(map(q.quoted, d)) + "], [" + ", ".join(map(q.quoted, d.values())) + "])"
    # Without a semicolon the longest name that leads the reference counts.
    bare = [n for n in html5 if not n.endswith(";")]
    old = {str(k): x for k, x in html._invalid_charrefs.items() if k}
    gone = ", ".join(str(k) for k in sorted(html._invalid_codepoints))
    return f"""ent as (select {literal({k: x for k, x in html5.items()})} as named,
    [{", ".join(q.quoted(n) for n in sorted(bare, key=len, reverse=True))}] as bare, {literal(old)} as old, [{gone}]::bigint[] as gone)"""


_CODE = "case when p[3:3] in ('x', 'X') then try_cast('0x' || rtrim(p[4:], ';') as bigint) else try_cast(rtrim(p[3:], ';') as bigint) end"
# Numbers too large for a bigint are too large for a character.
_NUMERIC = f"""list_transform([coalesce({_CODE}, 1114112)], lambda k: case when old[k::varchar] is not null then old[k::varchar]
    when k = 0 or k between 55296 and 57343 or k > 1114111 then chr(65533) when list_contains(gone, k) then '' else chr(k::int) end)[1]"""
_NAMED = "coalesce(named[p[2:]], list_transform(list_filter(bare, lambda n: starts_with(p[2:], n))[1:1], lambda n: named[n] || p[len(n) + 2:])[1], p)"


@query(
    "html_text",
    5,
    56,
    sql=f"""with {_entities_sql()}, x as (select page_id, regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '<[^>]+>', ' ', 'g')
    as x from pages), d as (select page_id, x, case when contains(x, '&') then list_transform(regexp_extract_all(x,
    '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\\t\\n\\f <&#;]{{1,32}};?|[^&]+|&'), lambda p: case when not starts_with(p, '&') or p = '&' then p
    when starts_with(p, '&#') then {_NUMERIC} else {_NAMED} end) else [x] end as ps from x cross join ent)
    select page_id, case when x is not null then trim(regexp_replace(array_to_string(ps, ''), '[\\t-\\r\\x{{85}}\\pZ]+', ' ', 'g'),
    ' ' || chr(28) || chr(29) || chr(30) || chr(31)) end as visible from d""",
)
def html_text(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", fi.html_text(F.col("html")).alias("visible"))


@query(
    "text_files",
    1,
    2,
    3,
    sql=f"""select lang, length(string_agg(x, chr(10))) as characters, count(*) as lines, count(*) filter (where
    {q.strip("x")} = '') as empty_lines from (select lang, unnest({q.lines("text")}) as x from documents) group by lang""",
)
def text_files(spark: SparkSession, root: str) -> DataFrame:
    """The documents written as text files per language, then read as files and as lines."""
    path = scratch_path(spark, "texts")
    docs = table(spark, root, "documents").select("lang", F.explode(t.lines(F.col("text"))).alias("value"))
    docs.write.partitionBy("lang").text(path)
    of = lambda c: F.regexp_extract(c, "lang=([a-z]+)", 1).alias("lang")
    lines = fi.line_counts(fi.read_lines(spark, path, "*.txt")).groupBy(of("path")).agg(
        F.sum("lines").alias("lines"), F.sum("empty_lines").alias("empty_lines")
    )
    # Every file ends with a line feed, which joins it to the next file of the language.
    size = fi.read_files(spark, path, "*.txt").groupBy(of("path")).agg((F.sum(F.length("text")) - 1).alias("characters"))
    return size.join(lines, "lang")


@query("benchmark_files", 6, 7, sql="select item_id::varchar as query, text as expected_answer, 'set' as name from benchmark")
def benchmark_files(spark: SparkSession, root: str) -> DataFrame:
    """A benchmark set written as JSON documents, read back as queries."""
    path = scratch_path(spark, "benchmark")
    entry = F.struct(F.col("item_id").cast("string").alias("query"), F.col("text").alias("expected_answer"))
    sets = table(spark, root, "benchmark").select(F.lit("set").alias("name"), F.array(entry).alias("queries"))
    sets.repartition(4).write.option("maxRecordsPerFile", 1).json(path)
    return fi.read_benchmark_json(spark, path).select("query", "expected_answer", "name")


@query("benchmark_csv_files", 7, sql="select item_id::varchar as query, text as expected_answer from benchmark")
def benchmark_csv_files(spark: SparkSession, root: str) -> DataFrame:
    """A benchmark set written as CSV, read back as queries."""
    path = scratch_path(spark, "benchmark-csv")
    rows = table(spark, root, "benchmark").select(F.col("item_id").cast("string").alias("query"), F.col("text").alias("expected_answer"))
    ex.write_csv(rows, path)
    return fi.read_benchmark_csv(spark, path).select("query", "expected_answer")
