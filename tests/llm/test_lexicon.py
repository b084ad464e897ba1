"""The transducer lexicon against dictionaries and the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorespan.llm import lexicon

VOCABULARY = "byte_bpe_50k.json"
LIB = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def opened(tmp_path, entries):
    path = tmp_path / "x.lxt"
    path.write_bytes(lexicon.compile_lexicon(entries))
    return lexicon.Transducer(str(path))


def split(n, ids):
    return [ids[e - k : e].tolist() for k, e in zip(n, np.cumsum(n))]


@pytest.mark.parametrize("seed", range(4))
def test_transducer_is_the_dictionary(tmp_path, seed):
    rng = random.Random(seed)
    words = {bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(0, 7))) for _ in range(400)}
    table = {w: tuple(rng.randrange(5) for _ in range(rng.randint(0, 4))) for w in words}
    lex = opened(tmp_path, sorted(table.items()))
    asked = sorted(words) + [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    found, n, ids = lex.look_up(asked)
    assert found.tolist() == [w in table for w in asked]
    assert split(n, ids) == [list(table.get(w, ())) for w in asked]


def right_languages(words):
    """Distinct sets of what may follow a prefix: the states of the minimal acceptor."""
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    return len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_suffixes_are_shared(tmp_path):
    words = sorted(a + b for a in (b"walk", b"talk", b"mend", b"a") for b in (b"", b"ed", b"ing", b"s"))
    lex = opened(tmp_path, [(w, (7,)) for w in words])
    assert len(lex.last_n) == right_languages(words) and len(lex.key) < sum(map(len, words)) / 2
    # Ids that differ by stem alone stand before the stem's end, so the endings are shared as well.
    lex = opened(tmp_path, [(w, (w[0],)) for w in words])
    assert len(lex.last_n) <= right_languages(words) + 1


def test_order_is_asked_for(tmp_path):
    for bad in ([(b"b", ()), (b"a", ())], [(b"a", ()), (b"a", ())], [(b"", ()), (b"", ())]):
        with pytest.raises(ValueError):
            lexicon.compile_lexicon(bad)
    found, n, ids = opened(tmp_path, []).look_up([b"", b"x"])
    assert not found.any() and not len(ids)
    assert opened(tmp_path, [(b"", (3, 4))]).look_up([b""])[2].tolist() == [3, 4]


ODD = [
    None, "", " ", "a", "  two  spaces \n\n\ttab ", "it's they'll I'D 'sit", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "naïve café ½ ² x²",
    "日本語 テキスト", "मानक हिन्दी", "👩‍👩‍👧 ‍﻿", "֋౜ a", "x y z", "\0\x01\x7f", "0123 456,789.0 --- !!!", "é" * 50, "z" * 5000,
]


def want(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))


def test_odd_texts(spark):
    long = " ".join(f"word{k % 700}" for k in range(60_000))
    rows = [(k, t, 1, "s") for k, t in enumerate([*ODD, long])] + [(None, "a b", 1, "s"), (3, "a", 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 int, decoded string")
    lex = lexicon.build_lexicon(docs, VOCABULARY, size=20)
    back = lexicon.decode(lexicon.encode(docs, VOCABULARY, lex), VOCABULARY)
    assert back.columns == ["doc_id", "c0", "ids", "decoded"]
    got = back.collect()
    assert len(got) == len(rows) and all(r.c0 == 1 for r in got)
    texts = {k: t for k, t, *_ in rows}
    for r in got:
        assert list(r.ids) == LIB.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == LIB.decode(list(r.ids), skip_special_tokens=False) == (texts[r.doc_id] or "")
    none = docs.limit(0)
    assert lexicon.decode(lexicon.encode(none, VOCABULARY, lexicon.build_lexicon(none, VOCABULARY)), VOCABULARY).count() == 0


def test_decoding_of_any_ids(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 30))] for _ in range(200)] + [[50256, 50300, 5], [], None]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, ids array<int>")
    got = {r.k: r.decoded for r in lexicon.decode(rows, VOCABULARY).collect()}
    assert got == {k: None if x is None else LIB.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)}


def test_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([("a b<|endoftext|> b",), (" b",), (None,), ("",)], "text string")
    assert [(r.word, r.n) for r in lexicon.frequent_words(docs, VOCABULARY, 3).collect()] == [(" b", 3), ("a", 1)]


def test_whole_table_against_the_library(spark, root):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in lexicon.op13_bpe_transducer(spark, root).collect()}
    assert got == {k: want(t) for k, t in docs.items()}
