"""Language profiles against a direct computation, and held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np

from lorespan.llm import langid


def plain_bundle(text, space):
    letters = [c.lower()[0] if c.isalpha() else " " for c in f" {text} "]
    row = [c for i, c in enumerate(letters) if not (c == " " and i and letters[i - 1] == " ")]
    total = np.zeros(space.dimensions)
    for a, b, c in zip(row, row[1:], row[2:]):
        if b != " ":
            vectors = [np.roll(space.letter(0 if x == " " else ord(x)).astype(int), 2 - i) for i, x in enumerate((a, b, c))]
            total += vectors[0] * vectors[1] * vectors[2]
    return total


def test_bundles_by_hand():
    space = langid._Space(256, 3)
    texts = ["Der Hund, 12 Äpfel!", "x", "日本語 テキスト", "ab\n\nba ab", "123 !!", None, ""]
    got = space.bundles(texts, np.arange(len(texts)), len(texts))
    for text, row in zip(texts, got):
        assert np.allclose(row, plain_bundle(text or "", space)), text
    assert np.allclose(space.bundles(texts[:4], np.array([0, 1, 0, 1]), 2)[0], got[0] + got[2])


def test_many_signs_go_through_in_parts():
    space = langid._Space(64, 3)
    text = "".join(chr(0x4E00 + i * 7 % 900) for i in range(40_000))
    assert np.allclose(space.bundles([text], np.array([0]), 1)[0], plain_bundle(text, space), atol=1)


def test_held_out_accuracy(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = langid.op1_language_id(spark, root).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out and r.n_chars > 30]
    assert sum(held) / len(held) > 0.98


def test_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "the house of the king", "en", 1), (3, "la maison du roi", "fr", 1), (4, "12 3", None, 1)]
    rows += [(5, "the kings house", None, 0), (5, "the kings house", None, 0), (None, "la la maison", None, 0), (6, "", "de", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    known = langid.profiles(docs)
    assert list(known) == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, known).collect()}
    assert got[1] == got[4] == got[6] == ("und", 0.0)
    assert got[5][0] == "en" and got[None][0] == "fr"
    assert langid.predict(docs, known).count() == 8
    assert {r.lang_pred for r in langid.predict(docs, langid.profiles(docs.limit(0))).collect()} == {"und"}
    assert langid.identified(docs.limit(0)).count() == 0
