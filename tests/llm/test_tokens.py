"""Token counts and token files against the library's own answers."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from lorespan.llm import pfor, tokencount
from lorespan.llm.tokens import encoder
from lorespan.session import scratch_path

ODD = [
    "", " ", "  ", "\n", "a  b", "a \n b", " lead", "trail ", "x\ty", "a b", "don't stop, it's. 12 34th",
    "<|endoftext|> a <|endoftext|>", "a\n\nb", "é É ß ŐŰ İstanbul ΣΑΣ ǅ", "\x1c a\x1db", "..., ,,. a.,",
    "中文 字符 ñandú²", "tab\t\ttab a\r\nb", "word.\n\nWord \n x", "😀 a😀, b", "a" * 300 + " b", "'s 's's", "ªb ºc µ,",
    "nul\x00 \x00", "word " * 3000 + ".",
]


def direct(name, text):
    return encoder(name).lib.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(root):
    rng = random.Random(3)
    parts = [" ", "\n", "a", "B", "é", ".", ",", "'", "s", "1", "\t", "  ", "́", "İ", "<|endoftext|>", "-"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(800)]
    return ODD + made + ds.dataset(f"{root}/documents.parquet").to_table(columns=["text"])["text"].to_pylist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(texts, name):
    for t in texts:
        assert np.frombuffer(encoder(name).ids(t), "<u4").tolist() == direct(name, t), repr(t[:50])


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr("lorespan.llm.tokens.REMEMBER", 3)
    enc = type(encoder("byte_bpe_50k.json"))("byte_bpe_50k.json")
    text = "one two three four five one two three, four. five"
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == direct("byte_bpe_50k.json", text)


def frame(spark, texts):
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "no id", 0), (5, None, 0), (6, ODD[6], 6)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, pieces int").repartition(3)


def test_counts(spark, texts, monkeypatch):
    monkeypatch.setattr(tokencount, "BLOCK_ROWS", 100)
    rows, docs = frame(spark, texts)
    got = sorted((tuple(r) for r in tokencount.token_counts(docs, "byte_bpe_50k.json", 20).collect()), key=str)
    n = [len(direct("byte_bpe_50k.json", t)) for _, t, _ in rows]
    want = [(i, len((t or "").encode()), k, k > 20) for (i, t, _), k in zip(rows, n)]
    assert got == sorted(want, key=str)
    assert tokencount.token_counts(docs.limit(0), "byte_bpe_50k.json", 20).count() == 0


def test_counts_with_a_normalizing_vocabulary(spark, texts):
    rows, docs = frame(spark, texts)
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, "word_bpe_49k.json", 20).collect()}
    assert all(got[i] == len(direct("word_bpe_49k.json", t)) for i, t, _ in rows[: len(texts)] if i not in (5,))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_257, 2**32])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::11] = 0
    blocks = pfor.pack(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert not n or (pfor.unpack(b"".join(blocks), starts) == ids).all()


def test_files_round_trip(spark, texts, monkeypatch):
    monkeypatch.setattr(pfor, "WINDOW", 4)
    rows, docs = frame(spark, texts)
    path = scratch_path(spark, "ids")
    manifest = pfor.write_ids(docs, path, "byte_bpe_50k.json", 2)
    got = sorted(pfor.read_ids(manifest, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i))
    start, want = 0, sorted((str(i), tuple([*direct("byte_bpe_50k.json", t), 2])) for i, t, _ in rows)
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    shard = manifest.orderBy("shard").collect()[0]
    with pfor._place(path)[0].open_input_file(f"{pfor._place(path)[1]}/{shard.file}") as f:
        reader = pfor.ShardReader(f)
        assert reader.document(3).astype("<u4").tobytes() == bytes(got[3].ids)
    empty = scratch_path(spark, "ids")
    assert pfor.read_ids(pfor.write_ids(docs.limit(0), empty, "byte_bpe_50k.json", 2), empty).count() == 0


def test_arrow_values_of_wide_texts():
    batch = pa.record_batch({"t": ["x" * 3_000_000, None, "y" * 3_000_000, "z"]})
    from lorespan.llm.common import slices

    assert [len(v) for _, v in slices(iter([batch]), "t")] == [3, 1]


def test_a_worker_keeps_the_memory_of_one_kind_of_step():
    import weakref

    from lorespan.llm import langid

    old = weakref.ref(encoder("word_bpe_49k.json"))
    assert encoder("word_bpe_49k.json") is old()
    space = weakref.ref(langid._space(64, 1))
    assert langid._space(64, 1) is space() and old() is None
    encoder("word_bpe_49k.json")
    assert space() is None
