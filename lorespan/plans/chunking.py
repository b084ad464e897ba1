"""Queries over splitting, chunking, Markdown structure and text statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorespan.functions import chunking as k, text as t
from lorespan.operators import chunk, structure, textstats
from lorespan.plans import sqltext as q
from lorespan.plans.registry import query
from lorespan.sources.tables import table

# All documents with frequent words turned into the syntax that a splitter looks for. Fixed values.
SYNTAX = {
    "markdown": (
        (". ", ".\n\n## Part\n"),
        (" the ", "\n| a | the |\n| b | c |\n"),
        (" de ", "\n- de "),
        (" of ", " [of](http://x.example/of) "),
        (" and ", " ![and](and.png) "),
        (" in ", "\n```py\nin(1)\n```\n"),
        (" der ", "\n```\nder\n```\n"),
    ),
    "paragraphs": ((".\n", ".\n\n"),),
    "code": ((". ", "\ndef "), (", ", "\nclass ")),
    "yaml": ((".\n", "\n---\n"),),
    "sql": ((". ", ";\n"),),
    "logs": ((".\n", ".\n2024-03-01 10:00:00 "),),
    "csv": ((". ", ".\n"),),
}


def written(spark: SparkSession, root: str, syntax: str) -> DataFrame:
    docs = table(spark, root, "documents")
    text = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), SYNTAX[syntax], F.col("text"))
    if syntax == "markdown":
        text = F.concat(
            F.lit("---\ntitle: "), "source", F.lit("\nlang: "), "lang", F.lit("\n---\n# Top\n"), text
        )
    return docs.select("doc_id", text.alias("text"), "source")


def _written_sql(syntax: str) -> str:
    text = reduce(lambda x, p: f"replace({x}, {q.quoted(p[0])}, {q.quoted(p[1])})", SYNTAX[syntax], "text")
    if syntax == "markdown":
        text = f"'---\ntitle: ' || source || '\nlang: ' || lang || '\n---\n# Top\n' || {text}"
    return f"w as (select doc_id, {text} as text, source from documents)"


def _list_query(name: str, row: int, pieces: str, strategy: str, syntax: str | None = None, **opts) -> None:
    """A strategy compared as (doc_id, chunk_index, text)."""
    base = f"with {_written_sql(syntax)}" if syntax else "with w as (select doc_id, text from documents)"

    @query(
        name,
        row,
        sql=f"""{base}, p as (select doc_id, {pieces} as ps from w)
        select doc_id, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as chunk_index from p""",
    )
    def run(spark: SparkSession, root: str) -> DataFrame:
        docs = written(spark, root, syntax) if syntax else table(spark, root, "documents")
        return chunk.chunk_documents(docs, strategy, **opts).select("doc_id", "chunk_index", "text")


def _windows(x: str, size: int, step: int) -> str:
    return f"list_transform(range(0, length({x}), {step}), lambda i: substring({x}, i + 1, {size}))"


def _word_windows(x: str, size: int, step: int) -> str:
    w = q.words(x)
    return f"list_transform(range(0, len({w}), {step}), lambda i: array_to_string(({w})[i + 1:i + {size}], ' '))"


def _pack(pieces: str, weight: str, fits: str, grow: str, first: str = "w", sep: str = "' '") -> str:
    """Greedy packing as a list fold; in the fragments ``c`` is the current and ``w`` the next weight."""
    step = (
        "lambda a, x: case when a.i = 0 then {'starts': [0], 'c': FIRST, 'i': 1} "
        "when FITS then {'starts': a.starts, 'c': GROW, 'i': a.i + 1} "
        "else {'starts': list_append(a.starts, a.i), 'c': W, 'i': a.i + 1} end"
    )
    step = step.replace("FIRST", first).replace("FITS", fits).replace("GROW", grow).replace("W", "w")
    for name, value in (("w", f"({weight})"), ("c", "a.c")):
        step = _word_sub(step, name, value)
    zero = "{'starts': []::bigint[], 'c': 0::bigint, 'i': 0::bigint}"
    starts = f"list_reduce(list_transform({pieces}, lambda x: length(x)), {step}, {zero}).starts"
    return (
        f"list_transform({starts}, lambda s, j: array_to_string(({pieces})[s + 1:"
        f"coalesce(({starts})[j + 1], len({pieces}))], {sep}))"
    )


def _word_sub(text: str, name: str, value: str) -> str:
    import re

    return re.sub(rf"(?<![\w.']){name}(?![\w'])", value, text)


_list_query("chunk_characters", 102, q.not_blank(_windows("text", 1000, 900)), "characters")
_list_query("chunk_words", 104, _word_windows("text", 200, 180), "words")
_list_query("chunk_tokens", 105, _word_windows("text", 100, 100), "token", max_tokens=100)
_list_query(
    "chunk_token_windows",
    106,
    f"case when {q.n_words('text')} <= 100 then [text] else {_word_windows('text', 100, 70)} end",
    "windows",
    max_tokens=100,
    overlap=30,
)
_list_query("chunk_separator", 108, q.not_blank("string_split(text, ', ')"), "separator", separator=", ")
_list_query(
    "chunk_separator_kept",
    108,
    f"list_filter({q.cut('text', ', ', ', ')}, lambda p: {q.strip('p')} <> '')",
    "separator",
    separator=", ",
    keep=True,
)
_list_query("split_sentences", 109, q.sentences("text"), "sentences")
_list_query("split_paragraphs", 110, q.paragraphs("text"), "paragraphs", "paragraphs")
_list_query("chunk_headings", 118, q.not_blank(q.cut("text", r"(?m)^(#{1,6}\s)", "") .replace("'' || chr(1)", "chr(1) || '\\1'")), "heading", "markdown")
_list_query(
    "chunk_code",
    119,
    q.not_blank(
        "string_split(regexp_replace(text, '(?m)^(\\s*(?:def|class)\\s+)', chr(1) || '\\1', 'g'), chr(1))"
    ),
    "code",
    "code",
)
_list_query("chunk_source_code", 119, q.not_blank(_windows("text", 1500, 1350)), "source_code", "code")
_list_query("split_yaml", 123, q.not_blank(q.cut("text", r"(?m)^---\s*$")), "yaml", "yaml")
_list_query("split_sql", 124, q.not_blank(q.cut("text", r";\s*\n")), "sql", "sql")
_list_query(
    "split_logs",
    125,
    q.not_blank("string_split(regexp_replace(text, '\\n(\\d{4}-\\d{2}-\\d{2})', chr(1) || '\\1', 'g'), chr(1))"),
    "logs",
    "logs",
)
_CSV = q.lines("text")
_list_query(
    "split_csv",
    122,
    f"list_transform(range(0, len({_CSV}) - 1, 10), lambda i: array_to_string(list_concat(({_CSV})[1:1], "
    f"({_CSV})[i + 2:i + 11]), chr(10)))",
    "csv",
    "csv",
    rows=10,
)
_SENT = q.sentences("text")
_list_query("chunk_sentences", 111, _pack(_SENT, "x", "c + w + 1 <= 500", "c + 1 + w"), "sentence")
_list_query(
    "chunk_token_split",
    112,
    _pack(_SENT, "greatest(1, x // 4)", "c + w <= 128", "c + w"),
    "token_split",
    max_tokens=128,
)


@query(
    "chunk_fixed",
    103,
    sql=f"""with s as (select doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 450)) as a from documents
    where text <> ''), c as (select doc_id, a, {q.strip("substring(text, a + 1, 500)")} as text,
    least(a + 500, length(text)) as e from s)
    select doc_id, a // 450 as chunk_index, text, a as start_char, e as end_char,
    greatest(1, {q.n_words("text")}) as token_count, {q.n_words("text")} as word_count from c""",
)
def chunk_fixed(spark: SparkSession, root: str) -> DataFrame:
    return chunk.chunk_documents(table(spark, root, "documents"), "fixed")


@query(
    "chunk_paragraphs",
    110,
    sql=f"""with {_written_sql("paragraphs")}, p as (select doc_id, {q.not_blank("string_split(text, chr(10) || chr(10))")}
    as ps from w), u as (select doc_id, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as chunk_index from p)
    select *, coalesce(sum(length(text) + 2) over (partition by doc_id order by chunk_index
    rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from u""",
)
def chunk_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return chunk.chunk_documents(written(spark, root, "paragraphs"), "paragraph").select(
        "doc_id", "text", "chunk_index", "start_char"
    )


@query(
    "chunk_overlap",
    107,
    sql=f"""with p as (select doc_id, {_word_windows("text", 100, 100)} as ps from documents),
    c as (select doc_id, unnest(ps) as x, generate_subscripts(ps, 1) - 1 as chunk_index from p),
    l as (select *, lag(x) over (partition by doc_id order by chunk_index) as y from c)
    select doc_id, chunk_index, case when y is null then x else
    array_to_string(({q.words("y")})[greatest(1, {q.n_words("y")} - 9):], ' ') || ' ' || x end as text from l""",
)
def chunk_overlap(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return chunk.chunk_texts(docs, chunk.with_overlap(k.token_blocks(F.col("text"), 100), 10))


_REST = "c + w < 400"


@query(
    "chunk_recursive_split",
    113,
    sql=f"""with {_written_sql("paragraphs")}, p as (select doc_id, {q.paragraphs("text")} as ps from w),
    u as (select doc_id, unnest(ps) as text, generate_subscripts(ps, 1) as i from p),
    g as (select doc_id, i, case when length(text) <= 400 then [text] else
    {_pack(_SENT, "x", "c + w < 400", "c + 1 + w", "case when w < 400 then w + 1 else w end")} end as ps from u),
    f as (select doc_id, i, unnest(ps) as text, generate_subscripts(ps, 1) as j from g)
    select doc_id, text, row_number() over (partition by doc_id order by i, j) - 1 as chunk_index from f""",
)
def chunk_recursive_split(spark: SparkSession, root: str) -> DataFrame:
    docs = written(spark, root, "paragraphs")
    return chunk.chunk_documents(docs, "recursive_split", size=400).select("doc_id", "text", "chunk_index")


@query(
    "chunk_recursive",
    114,
    127,
    sql=f"""with p as (select doc_id, case when length(text) <= 500 then [text] else
    {q.not_blank("string_split(text, chr(10) || chr(10))")} end as ps from documents where text <> ''),
    u as (select doc_id, unnest(ps) as text, generate_subscripts(ps, 1) as i from p),
    g as (select doc_id, i, case when length(text) <= 500 then [text] else
    {_pack(_SENT, "x", "c + w + 1 <= 500", "c + 1 + w")} end as ps from u),
    f as (select doc_id, i, unnest(ps) as text, generate_subscripts(ps, 1) as j from g),
    h as (select doc_id, i, j, case when length(text) <= 500 then [{q.strip("text")}] else
    list_transform(range(0, length(text) - 50, 450), lambda a: {q.strip("substring(text, a + 1, 500)")}) end as ps from f),
    z as (select doc_id, i, j, unnest(ps) as text, generate_subscripts(ps, 1) as k from h)
    select doc_id, text, row_number() over (partition by doc_id order by i, j, k) - 1 as chunk_index,
    null::bigint as start_char, null::bigint as end_char, greatest(1, {q.n_words("text")}) as token_count,
    {q.n_words("text")} as word_count from z""",
)
def chunk_recursive(spark: SparkSession, root: str) -> DataFrame:
    return chunk.chunk_documents(table(spark, root, "documents"), "recursive")


@query("chunk_hierarchy", 115)
def chunk_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    return chunk.chunk_documents(table(spark, root, "documents"), "hierarchy")


@query(
    "merge_small",
    116,
    sql=f"""with s as (select doc_id, {_SENT} as ss from documents), m as (select doc_id,
    {_pack("ss", "x", "c + w < 100", "c + 1 + w", "case when w < 100 then w + 1 else w end", "chr(10)")} as ps from s)
    select doc_id, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as chunk_index from m""",
)
def merge_small(spark: SparkSession, root: str) -> DataFrame:
    return chunk.chunk_texts(table(spark, root, "documents"), k.merge_small(t.sentences(F.col("text"))))


@query(
    "merge_small_chunks",
    117,
    sql=f"""with s as (select doc_id, {_SENT} as ss from documents), m as (select doc_id,
    {_pack("ss", "x", "c < 120", "c + 1 + w", "w", "chr(10)")} as ps from s)
    select doc_id, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as chunk_index from m""",
)
def merge_small_chunks(spark: SparkSession, root: str) -> DataFrame:
    spans = chunk._with_offsets(t.sentences(F.col("text")), 1)
    merged = chunk.explode_spans(table(spark, root, "documents"), chunk.merge_small_spans(spans))
    return merged.select("doc_id", "text", "chunk_index")


_TAGS = "h1 h2 h3 h4 p li pre code blockquote".split()


@query(
    "split_html",
    120,
    5,
    sql="""with b as (select page_id, regexp_extract_all(html,
    '(?is)<(?:h1\\b[^>]*>.*?</h1|h2\\b[^>]*>.*?</h2|h3\\b[^>]*>.*?</h3|h4\\b[^>]*>.*?</h4|p\\b[^>]*>.*?</p|"""
    """li\\b[^>]*>.*?</li|pre\\b[^>]*>.*?</pre|code\\b[^>]*>.*?</code|blockquote\\b[^>]*>.*?</blockquote)\\s*>', 0)
    as bs from pages), t as (select page_id, list_filter(list_transform(bs, lambda x:
    trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') as ps from b)
    select page_id, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as chunk_index from t""",
)
def split_html(spark: SparkSession, root: str) -> DataFrame:
    return chunk.chunk_texts(table(spark, root, "pages"), k.split_html(F.col("html")), "page_id")


@query(
    "split_json",
    121,
    sql="""select doc_id, unnest(['doc_id: ' || doc_id, 'lang: ' || lang, 'source: ' || source]) as text from documents
    union all select conv_id, role from conversations union all select conv_id, turn::varchar from conversations""",
)
def split_json(spark: SparkSession, root: str) -> DataFrame:
    objects = table(spark, root, "documents").select(
        "doc_id", F.to_json(F.struct("doc_id", "lang", "source")).alias("json")
    )
    lists = table(spark, root, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.to_json(F.array("role", F.col("turn").cast("string"))).alias("json")
    )
    return chunk.chunk_texts(objects.unionByName(lists), k.split_json(F.col("json"))).select("doc_id", "text")


@query(
    "chunk_by_extension",
    126,
    sql=f"""with w as (select doc_id, case lang when 'en' then 'csv' when 'fr' then 'sql' else 'yaml' end as ext,
    text from documents), p as (select doc_id, case ext when 'sql' then {q.not_blank(q.cut("text", chr(59) + r"\s*\n"))}
    when 'yaml' then {q.not_blank(q.cut("text", r"(?m)^---\s*$"))} else list_transform(range(0, len({_CSV}) - 1, 100),
    lambda i: array_to_string(list_concat(({_CSV})[1:1], ({_CSV})[i + 2:i + 101]), chr(10))) end as ps from w)
    select doc_id, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as chunk_index from p""",
)
def chunk_by_extension(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "csv").when(F.col("lang") == "fr", "sql").otherwise("yaml")
    docs = table(spark, root, "documents")
    return chunk.chunk_texts(docs, k.split_file(F.col("text"), kind))


@query(
    "chunk_metadata",
    129,
    128,
    sql=f"""with p as (select doc_id, source, {_word_windows("text", 200, 180)} as ps from documents),
    u as (select doc_id, source, unnest(ps) as x, generate_subscripts(ps, 1) - 1 as chunk_index from p)
    select doc_id, source, chunk_index, count(*) over (partition by doc_id) as total_chunks, length(x) as characters,
    {q.n_words("x")} as words from u order by doc_id, chunk_index""",
)
def chunk_metadata(spark: SparkSession, root: str) -> DataFrame:
    return chunk.sort_chunks(chunk.build_metadata(table(spark, root, "documents"), "words"))


@query(
    "validate_chunks",
    44,
    sql="select doc_id, true as valid from documents where text <> ''",
)
def validate_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunk.validate_chunks(chunk.chunk_documents(table(spark, root, "documents"), "fixed"))


@query(
    "chunks_by_length",
    42,
    43,
    sql=f"""with p as (select doc_id, {_SENT} as ps from documents), u as (select doc_id, unnest(ps) as text from p)
    select * from u where length(text) >= 30 and {q.strip("text")} <> ''""",
)
def chunks_by_length(spark: SparkSession, root: str) -> DataFrame:
    chunks = chunk.chunk_documents(table(spark, root, "documents"), "sentences").select("doc_id", "text")
    return chunk.filter_by_length(chunk.remove_empty(chunks), 30)


@query(
    "chunk_statistics",
    141,
    sql=f"""with p as (select source, {_word_windows("text", 200, 180)} as ps from documents),
    u as (select source, unnest(ps) as x from p), n as (select source, x, {q.n_words("x")} as w from u)
    select source, count(*) as chunks, round(avg(greatest(1, w)), 6) as avg_tokens, round(avg(w), 6) as avg_words,
    max(greatest(1, w)) as max_tokens, min(greatest(1, w)) as min_tokens, sum(length(x))::bigint as characters
    from n group by source""",
)
def chunk_statistics(spark: SparkSession, root: str) -> DataFrame:
    chunks = chunk.chunk_documents(table(spark, root, "documents"), "words", carry=("source",))
    return chunk.chunk_statistics(chunks, ("source",))


# Structure -------------------------------------------------------------------------------------------------------

_H = r"(?m)^(#{1,6})\s+(.*)$"
_MD = f"with {_written_sql('markdown')}"


@query(
    "markdown_headings",
    130,
    sql=f"""{_MD}, p as (select doc_id, regexp_extract_all(text, '{_H}', 1) as a, regexp_extract_all(text, '{_H}', 2) as b
    from w) select doc_id, generate_subscripts(a, 1) as n, length(unnest(a)) as level, {q.strip("unnest(b)")} as title
    from p""",
)
def markdown_headings(spark: SparkSession, root: str) -> DataFrame:
    return structure.headings(written(spark, root, "markdown"))


_F = r"(?s)```([\p{L}\p{N}_]+)?\n(.*?)```"


@query(
    "markdown_code_blocks",
    131,
    sql=f"""{_MD}, p as (select doc_id, regexp_extract_all(text, '{_F}', 1) as a, regexp_extract_all(text, '{_F}', 2) as b
    from w), u as (select doc_id, generate_subscripts(a, 1) as n, unnest(a) as l, unnest(b) as c from p)
    select doc_id, n, case when coalesce(l, '') = '' then 'text' else l end as language, rtrim(c, {q.TRIM}) as code
    from u""",
)
def markdown_code_blocks(spark: SparkSession, root: str) -> DataFrame:
    return structure.code_blocks(written(spark, root, "markdown"))


@query(
    "markdown_lists",
    132,
    sql=f"""{_MD}, p as (select doc_id, regexp_extract_all(text, '(?m)^\\s*[-*+]\\s+(.*)$', 1) as a from w)
    select doc_id, generate_subscripts(a, 1) as n, {q.strip("unnest(a)")} as item from p""",
)
def markdown_lists(spark: SparkSession, root: str) -> DataFrame:
    return structure.list_items(written(spark, root, "markdown"))


@query(
    "markdown_tables",
    133,
    sql=f"""{_MD}, l as (select doc_id, unnest({_CSV}) as x, generate_subscripts({_CSV}, 1) as i from w),
    m as (select *, i - row_number() over (partition by doc_id order by i) as g from l where contains(x, '|')),
    t as (select doc_id, g, min(i) as i, string_agg(x, chr(10) order by i) as table_text from m group by doc_id, g)
    select doc_id, row_number() over (partition by doc_id order by i) as n, table_text from t""",
)
def markdown_tables(spark: SparkSession, root: str) -> DataFrame:
    return structure.tables(written(spark, root, "markdown"))


_L = r"\[(.*?)\]\((.*?)\)"


@query(
    "markdown_links",
    134,
    sql=f"""{_MD}, p as (select doc_id, regexp_extract_all(text, '{_L}', 1) as a, regexp_extract_all(text, '{_L}', 2) as b
    from w) select doc_id, generate_subscripts(a, 1) as n, unnest(a) as text, unnest(b) as url from p""",
)
def markdown_links(spark: SparkSession, root: str) -> DataFrame:
    return structure.links(written(spark, root, "markdown"))


@query(
    "markdown_images",
    134,
    sql=f"""{_MD}, p as (select doc_id, regexp_extract_all(text, '!{_L}', 1) as a,
    regexp_extract_all(text, '!{_L}', 2) as b from w)
    select doc_id, generate_subscripts(a, 1) as n, unnest(a) as alt, unnest(b) as path from p""",
)
def markdown_images(spark: SparkSession, root: str) -> DataFrame:
    return structure.images(written(spark, root, "markdown"))


@query(
    "markdown_front_matter",
    135,
    sql="select doc_id, unnest(['title', 'lang']) as name, unnest([source, lang]) as value from documents",
)
def markdown_front_matter(spark: SparkSession, root: str) -> DataFrame:
    return structure.front_matter(written(spark, root, "markdown"))


_SECTIONS = f"""{_MD}, c as (select doc_id, string_split(regexp_replace(text, '(?m)^(#{{1,6}}\\s+.*)$',
    chr(1) || '\\1' || chr(2), 'g'), chr(1)) as ps from w),
    u as (select doc_id, unnest(ps[2:]) as p, generate_subscripts(ps[2:], 1) as n from c),
    s as (select doc_id, n, split_part(p, chr(2), 1) as h, {q.strip("split_part(p, chr(2), 2)")} as content from u),
    z as (select doc_id, n, {q.strip("regexp_extract(h, '^#+(.*)$', 1)")} as heading,
    length(regexp_extract(h, '^(#+)', 1)) as level, content from s)"""


@query("markdown_sections", 136, sql=f"{_SECTIONS} select * from z")
def markdown_sections(spark: SparkSession, root: str) -> DataFrame:
    return structure.sections(written(spark, root, "markdown"))


@query(
    "search_sections",
    37,
    sql=f"{_SECTIONS} select doc_id, n, heading, level, substring(content, 1, 300) as preview from z "
    "where contains(lower(content), 'tion')",
)
def search_sections(spark: SparkSession, root: str) -> DataFrame:
    return structure.search_sections(written(spark, root, "markdown"), "TION")


@query(
    "markdown_statistics",
    137,
    sql=f"""{_MD}, l as (select doc_id, unnest({_CSV}) as x, generate_subscripts({_CSV}, 1) as i from w),
    m as (select *, i - row_number() over (partition by doc_id order by i) as g from l where contains(x, '|')),
    t as (select doc_id, count(distinct g) as tables from m group by doc_id)
    select doc_id, length(text) as characters, {q.n_words("text")} as words, len({_CSV}) as lines,
    len(regexp_extract_all(text, '{_H}')) as headings, greatest(1, len(regexp_extract_all(text, '{_H}'))) as sections,
    coalesce(tables, 0) as tables, len(regexp_extract_all(text, '{_L}')) as links,
    len(regexp_extract_all(text, '!{_L}')) as images, len(regexp_extract_all(text, '{_F}')) as code_blocks,
    len(regexp_extract_all(text, '(?m)^\\s*[-*+]\\s+(.*)$')) as lists from w left join t using (doc_id)""",
)
def markdown_statistics(spark: SparkSession, root: str) -> DataFrame:
    return structure.markdown_statistics(written(spark, root, "markdown"))


def _plain_sql(x: str) -> str:
    for pattern, to in (
        (r"(?s)^---\n.*?\n---\n?", ""),
        (r"(?m)^```.*$\n?", ""),
        ("`([^`]*)`", r"\1"),
        (r"!\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"(?m)^\s*[-*+]\s+", ""),
        (r"(?m)^>\s?", ""),
        (r"[*_]{1,3}([^*_\n]+)[*_]{1,3}", r"\1"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return q.strip(x)


@query("markdown_plain_text", 137, sql=f"{_MD} select doc_id, {_plain_sql('text')} as plain from w")
def markdown_plain_text(spark: SparkSession, root: str) -> DataFrame:
    return written(spark, root, "markdown").select("doc_id", structure.plain_text(F.col("text")).alias("plain"))


# Statistics ------------------------------------------------------------------------------------------------------

_T = "length(text)"


@query(
    "text_statistics",
    139,
    151,
    sql=f"""select doc_id, {_T} as characters, {q.n_words("text")} as words, len({_CSV}) as lines,
    len(list_filter({_CSV}, lambda l: {q.strip("l")} = '')) as empty_lines,
    len({q.cut("text", chr(92) + "n" + chr(92) + "s*" + chr(92) + "n")}) as paragraphs,
    len(list_filter({q.cut("text", "[.!?]+")}, lambda p: {q.strip("p")} <> '')) as sentences from documents""",
)
def text_statistics(spark: SparkSession, root: str) -> DataFrame:
    return textstats.statistics(table(spark, root, "documents"))


@query(
    "token_estimates",
    140,
    sql=f"""select doc_id, greatest(1, {_T} // 4) as chars4, case when text = '' then 0 else greatest(1, {_T} // 4) end
    as chars4_or_zero, {_T} // 4 as chars4_floor, greatest(1, {q.n_words("text")}) as words,
    greatest(1, {q.n_words("text")} * 13 // 10) as words13 from documents""",
)
def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    return textstats.token_estimates(table(spark, root, "documents"))


@query(
    "token_statistics",
    142,
    143,
    sql=f"""with n as (select greatest(1, {q.n_words("text")} * 13 // 10) as n from documents)
    select count(*) as documents, sum(n)::bigint as total_tokens, min(n) as minimum, max(n) as maximum,
    round(avg(n), 2) as average, round(median(n), 2) as median from n""",
)
def token_statistics(spark: SparkSession, root: str) -> DataFrame:
    return textstats.token_statistics(table(spark, root, "documents"))


@query(
    "fits_context",
    144,
    sql=f"""with n as (select doc_id, greatest(1, {q.n_words("text")} * 13 // 10) as used from documents)
    select doc_id, used, greatest(0, 512 - used) as remaining, used <= 512 as fits from n""",
)
def fits_context(spark: SparkSession, root: str) -> DataFrame:
    return textstats.fits_context(table(spark, root, "documents"))


@query(
    "truncate_texts",
    145,
    sql=f"""select doc_id, array_to_string(({q.words("text")})[1:50], ' ') as words, substring(text, 1, 12000) as chars,
    substring(text, 1, 400) as tokens from documents""",
)
def truncate_texts(spark: SparkSession, root: str) -> DataFrame:
    x = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id",
        textstats.truncate_words(x, 50).alias("words"),
        textstats.truncate_characters(x).alias("chars"),
        textstats.truncate_tokens(x, 100).alias("tokens"),
    )


@query(
    "prompt_statistics",
    146,
    sql=f"""select conv_id, turn, length(text) as characters, length(text) // 4 as tokens,
    len({_CSV}) as lines from conversations""",
)
def prompt_statistics(spark: SparkSession, root: str) -> DataFrame:
    return textstats.prompt_statistics(table(spark, root, "conversations"), keys=("conv_id", "turn"))


_STATE = "case when l.doc_id is null then 'new' when toxic = 1 then 'failed' when quality = 1 then 'indexed' else 'processed' end"


def _with_status(spark: SparkSession, root: str) -> DataFrame:
    labels = table(spark, root, "labels").withColumn("seen", F.lit(True))
    return table(spark, root, "documents").join(labels, "doc_id", "left").withColumn(
        "status",
        F.when(F.col("seen").isNull(), "new")
        .when(F.col("toxic") == 1, "failed")
        .when(F.col("quality") == 1, "indexed")
        .otherwise("processed"),
    )


@query(
    "status_funnel",
    147,
    sql="select source, "
    + ", ".join(f"count(*) filter (where status = '{s}') as \"{s}\"" for s in textstats.DOCUMENT_STATES)
    + f" from (select source, {_STATE} as status from documents d left join labels l using (doc_id)) group by source",
)
def status_funnel(spark: SparkSession, root: str) -> DataFrame:
    return textstats.status_funnel(_with_status(spark, root))


@query(
    "processed_documents",
    48,
    sql=f"select doc_id, status in ('processed', 'indexed', 'embedded') as processed from (select d.doc_id, {_STATE} "
    "as status from documents d left join labels l on l.doc_id = d.doc_id)",
)
def processed_documents(spark: SparkSession, root: str) -> DataFrame:
    docs = _with_status(spark, root)
    return docs.select("doc_id", textstats.is_processed(F.col("status")).alias("processed"))


@query(
    "tag_counts",
    148,
    sql="""with x as (select unnest([lang, source, case when n_chars > 1000 then 'long' else lang end]) as tag,
    doc_id from documents), y as (select distinct doc_id, tag from x where tag <> 'en')
    select tag, count(*) as documents from y group by tag""",
)
def tag_counts(spark: SparkSession, root: str) -> DataFrame:
    tags = F.array("lang", "source")
    tags = F.when(F.col("n_chars") > 1000, textstats.add_tag(tags, "long")).otherwise(textstats.add_tag(tags, "long"))
    tags = F.when(F.col("n_chars") > 1000, tags).otherwise(textstats.remove_tag(tags, "long"))
    tagged = table(spark, root, "documents").select(textstats.remove_tag(tags, "en").alias("tags"))
    return textstats.tag_counts(tagged)


@query(
    "mean_chunk_size",
    149,
    sql=f"""with n as (select doc_id, length(text) as characters, len({_SENT}) as chunks from documents)
    select doc_id, characters, chunks, case when chunks = 0 then 0.0 else round(characters::double / chunks, 2) end
    as mean_chunk_size from n""",
)
def mean_chunk_size(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return textstats.mean_chunk_size(docs, chunk.chunk_documents(docs, "sentences"))


@query(
    "compare_texts",
    150,
    sql=f"""with p as (select *, lead(text) over (partition by conv_id order by turn) as other,
    lead(role) over (partition by conv_id order by turn) as other_role from conversations)
    select conv_id, turn, role = other_role as same_role, abs(length(text) - length(other)) as character_difference,
    abs({q.n_words("text")} - {q.n_words("other")}) as word_difference,
    case when text = other then 1.0 else 0.0 end as similarity from p where other is not null""",
)
def compare_texts(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "conversations")
    following = turns.select(
        "conv_id",
        (F.col("turn") - 1).alias("turn"),
        F.col("text").alias("other"),
        F.col("role").alias("other_role"),
    )
    pairs = turns.join(following, ["conv_id", "turn"])
    return textstats.compare_pairs(pairs, "text", "other", {"same_role": ("role", "other_role")}).drop(
        "text", "other", "role", "other_role"
    )


@query(
    "normalized_tokens",
    152,
    sql=f"select doc_id, {q.normalize('text')} as normalized, len({q.tokens('text')}) as n_tokens from documents",
)
def normalized_tokens(spark: SparkSession, root: str) -> DataFrame:
    x = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id", t.normalize(x).alias("normalized"), F.size(t.tokens(x)).cast("long").alias("n_tokens")
    )
