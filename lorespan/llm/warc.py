"""A content-addressed web archive: payload bytes once by digest, record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan.session import scratch_path

#: Date of every record, unless the caller names a column: pages carry none.
DATE = "1970-01-01T00:00:00Z"
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexed: Column) -> Column:
    """Base32 of a hex string of 40 digits, five bytes at a time."""
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _record_id(page_id: Column) -> Column:
    """A name-based UUID of the page; a page without an id shares one."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """A header line; nothing for a null value. Line breaks inside a value are percent-encoded."""
    value = F.lit(value) if isinstance(value, str) else value
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archive(
    pages: DataFrame, path: str, min_bytes: int = 0, id: str = "page_id", url: str = "url", payload: str = "html"
) -> None:
    """Write a record per page below ``path``: ``headers`` (page, digest, exact header block) and ``payloads``.

    Payloads are UTF-8 bytes (null: none). Equal payloads of at least ``min_bytes`` bytes are one: the page with the
    largest id holds the response, the others revisit it; smaller payloads are responses each. Bytes are stored once
    per SHA-256, keyed by it; the writer fails if two payloads of a key differ in length, SHA-1 or XXH64.

    Rows without an id are responses of their own unless a row with an id holds their payload, as a revisit needs a
    page to refer to. Of repeated rows, one is the response and the others revisit it, which is its own id.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    facts = rows.select(
        "page_id",
        "url",
        F.sha2("body", 256).alias("key"),
        F.sha1("body").alias("sha1"),
        F.xxhash64("body").alias("check"),
        F.length("body").cast("long").alias("bytes"),
        # Which of repeated rows holds the response must be the same whenever a task runs again.
        F.xxhash64("page_id", "url").alias("row"),
    )
    checks = [F.min(c).alias(f"low_{c}") for c in ("sha1", "check", "bytes")] + [F.max(c).alias(f"high_{c}") for c in ("sha1", "check", "bytes")]
    groups = facts.groupBy("key").agg(F.max("page_id").alias("holder"), *checks)
    same = F.lit(True)
    for c in ("sha1", "check", "bytes"):
        same &= F.col(f"low_{c}") == F.col(f"high_{c}")
    holder = F.when(~same, F.raise_error(F.lit("different payloads of one digest"))).otherwise(F.col("holder"))
    groups = groups.select("key", holder.alias("holder"))
    known = facts.join(groups, "key")
    deep = Window.partitionBy("key", "page_id").orderBy("row", "url")
    is_holder = F.col("page_id") == F.col("holder")
    # Only rows of the holder's id can repeat it, so this window is as small as an id's repetitions.
    first = known.where(is_holder).withColumn("turn", F.row_number().over(deep))
    rest = known.where(~F.coalesce(is_holder, F.lit(False))).withColumn("turn", F.lit(0))
    known = first.unionByName(rest)
    response = (F.col("bytes") < min_bytes) | F.col("holder").isNull() | (F.col("turn") == 1)
    digest = base32(F.col("sha1"))
    shared = [
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Payload-Bytes", F.col("bytes").cast("string")),
        _line("WARC-Refers-To", F.when(~response, _record_id(F.col("holder")))),
        _line("X-Refers-To-Page", F.when(~response, F.col("holder").cast("string"))),
        _line("WARC-Profile", F.when(~response, F.lit(REVISIT))),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.when(response, F.col("bytes")).otherwise(0).cast("string")),
        F.lit("\r\n"),
    ]
    headers = known.select("page_id", F.when(response, F.col("key")).alias("key"), F.concat(*shared).cast("binary").alias("header"))
    headers.write.parquet(f"{path}/headers")
    # Copies of a payload are equal, so any of them will do; each task hands on one per key.
    once = rows.select(F.sha2("body", 256).alias("key"), "body").groupBy("key").agg(F.first("body").alias("body"))
    once.write.parquet(f"{path}/payloads")


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, header, body, record`` of every record, as its bytes stood; ``body`` is null for revisits.

    Payloads are checked against their digest as they are read; a damaged or missing one fails the read.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("body", 256) == F.col("key"), F.col("body"))
    payloads = payloads.select("key", F.coalesce(sound, F.raise_error(F.lit("damaged payload")).cast("binary")).alias("body"))
    joined = headers.join(payloads, "key", "left")
    missing = F.col("key").isNotNull() & F.col("body").isNull()
    body = F.when(missing, F.raise_error(F.lit("missing payload")).cast("binary")).otherwise(F.col("body"))
    end = F.lit(b"\r\n\r\n")
    record = F.concat(F.col("header"), F.coalesce(body, F.lit(b"")), end).alias("record")
    return joined.select("page_id", "header", body.alias("body"), record)


def full_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload`` of every page: a revisit gets the bytes of the response that it refers to.

    Responses that a third of all pages refer to are split by the engine's skew join as the referring side is the one
    that grows.
    """
    records = read_archive(spark, path)
    refers = _field(F.col("header").cast("string"), "X-Refers-To-Page").cast("long")
    records = records.select("page_id", "body", refers.alias("of"))
    held = records.where("body is not null and page_id is not null").select(F.col("page_id").alias("of"), F.col("body").alias("got"))
    revisits = records.where("of is not null").join(held, "of", "left").select("page_id", F.col("got").alias("payload"))
    return records.where("of is null").select("page_id", F.col("body").alias("payload")).union(revisits)


def described(spark: SparkSession, path: str) -> DataFrame:
    """What the records say: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Type, length and digest are taken from the header of every record; a response must have a body of that length and
    digest.
    """
    rows = read_archive(spark, path).withColumn("text", F.col("header").cast("string"))
    text = F.col("text")
    rows = rows.select(
        "page_id",
        "body",
        _field(text, "X-Payload-Bytes").cast("long").alias("payload_bytes"),
        F.substring(_field(text, "WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        _field(text, "WARC-Type").alias("record_type"),
        _field(text, "X-Refers-To-Page").cast("long").alias("refers_to"),
    )
    fits = (F.length("body") == F.col("payload_bytes")) & (base32(F.sha1("body")) == F.col("payload_digest"))
    wrong = (F.col("record_type") == "response") & ~F.coalesce(fits, F.lit(False))
    digest = F.when(wrong, F.raise_error(F.lit("record and header differ"))).otherwise(F.col("payload_digest"))
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op6_warc_archive(spark, root: str) -> DataFrame:
    """Every page's record, as the archive gives it back."""
    path = scratch_path(spark, "archive")
    write_archive(spark.read.parquet(f"{root}/pages.parquet"), path)
    return described(spark, path)


#: Payloads of at least 0 bytes are one response and its revisits.
SQL = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), g as (
  select page_id, body, max(page_id) over (partition by body) as holder, sha1(body) as h from p
), d as (
  select *, [cast('0x' || substr(h, 1 + 10 * i, 10) as bigint) for i in range(4)] as v from g
)
select page_id,
       cast(octet_length(encode(body)) as bigint) as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v[1 + k // 8] >> (35 - 5 * (k % 8))) & 31 as bigint) + 1, 1)
                        for k in range(32)], '') as payload_digest,
       case when page_id = holder then 'response' else 'revisit' end as record_type,
       case when page_id <> holder then holder end as refers_to
from d
"""
