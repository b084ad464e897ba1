"""The archive: exact records, payloads once, and damage that does not pass."""

from __future__ import annotations

import base64
import hashlib

import pyarrow.dataset as ds
import pytest

from lorespan.llm import warc
from lorespan.session import scratch_path


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def expected(rows):
    bodies = [(r[0], (r[2] or "").encode()) for r in rows]
    out, used = [], set()
    for page, body in bodies:
        holder = max((p for p, b in bodies if b == body and p is not None), default=None)
        response = holder is None or (page == holder and (page, body) not in used)
        used |= {(page, body)} if page is not None else set()
        out.append((page, len(body), digest(body), "response" if response else "revisit", None if response else holder))
    return sorted(out, key=str)


def test_whole_table(spark, root):
    rows = ds.dataset(f"{root}/pages.parquet").to_table(columns=["page_id", "url", "html"]).to_pylist()
    got = sorted((tuple(r) for r in warc.op6_warc_archive(spark, root).collect()), key=str)
    assert got == expected([tuple(r.values()) for r in rows])


@pytest.fixture
def archive(spark):
    rows = [
        (1, "http://a/", "same ü", 0), (7, "http://b/\r\nX: y", "same ü", 0), (3, None, "same ü", 0), (4, "u", None, 0), (5, "u", "", 0),
        (6, "v", "x" * 300_000, 0), (None, "w", "alone", 0), (None, "w", "same ü", 0), (7, "http://b/\r\nX: y", "same ü", 0),
        (8, "e", "é" * 20, 0), (2, "c", "other", 1), (None, "w", "alone", 0),
    ]
    path = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, key int"), path)
    return rows, path


def test_records(spark, archive):
    rows, path = archive
    got = sorted((tuple(r) for r in warc.described(spark, path).collect()), key=str)
    assert got == expected(rows)
    bodies = {(r[2] or "").encode() for r in rows}
    stored = [bytes(r.body) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert len(stored) == len(bodies) and set(stored) == bodies
    for r in warc.read_archive(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(lines["Content-Length"]) == len(rest) - 4
        assert lines["WARC-Type"] != "response" or lines["WARC-Payload-Digest"] == "sha1:" + digest(rest[:-4])
        assert "X" not in lines


def test_full_payloads(spark, archive):
    rows, path = archive
    got = sorted((str(r.page_id), bytes(r.payload)) for r in warc.full_payloads(spark, path).collect())
    assert got == sorted((str(r[0]), (r[2] or "").encode()) for r in rows)


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    path = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, min_bytes=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.described(spark, path).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_damage_is_noticed(spark, archive):
    _, path = archive
    broken = scratch_path(spark, "archive")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{broken}/headers")
    spark.read.parquet(f"{path}/payloads").selectExpr("key", "cast(concat(body, 'x') as binary) body").write.parquet(f"{broken}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.described(spark, broken).collect()


def test_empty_table(spark):
    path = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.described(spark, path).count() == 0
