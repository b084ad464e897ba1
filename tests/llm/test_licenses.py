"""License scans against rules applied one by one, without gates."""

from __future__ import annotations

import random
import re

import pyarrow.dataset as ds

from lorespan.llm import licenses


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


PATTERNS = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in licenses.RULES]


def plain(text):
    words = words_of(text)
    line = " " + " ".join(words) + " "
    base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = [(m.start(), m.end(), r.level, i) for i, r in enumerate(licenses.RULES) for m in PATTERNS[i].finditer(line)]

    def within(a, b):
        """Whether a is suppressed by b."""
        if a == b or not (b[0] <= a[0] and a[1] <= b[1]) or b[2] > a[2]:
            return False
        return b[2] < a[2] or (b[0], b[1]) != (a[0], a[1]) or b[3] < a[3]

    kept = [a for a in found if not any(within(a, b) for b in found)]
    labels = {label for _, label in base} | {licenses.RULES[i].label for *_, i in kept}
    return (
        len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
        ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)),
        max((licenses.RULES[i].weight for *_, i in kept), default=0.0),
    )


def test_there_are_hundreds_of_rules_with_true_keywords():
    assert len(licenses.RULES) > 300
    for r in licenses.RULES:
        assert any(all(w in r.pattern.replace("licen[cs]e", "license") + " " + r.keyword for w in a.split()) for a in licenses.ANCHORS) or r.keyword.startswith("cc ")


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = sorted((tuple(r)[:8] for r in licenses.scan(docs).collect()), key=str)
    want = sorted(((i, *plain(t)) for i, t, _ in rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w


def test_notices(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "All rights reserved.", "SPDX-License-Identifier: Apache-2.0",
        "CC BY CC-BY\ncc  by", "all rights reserved all rights reserved. General Public\nLicense", "cc by nc sa 4.0 international",
        "gnu lesser general public license version 2.1 or any later version", "Copyright (c) 2019, 2020 A. Person. Some rights reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "ALL RIGHTS\x00RESERVED",
        "GNU GPL general public licence v3", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "acc by", "cc bye", "cc by-",
        "released into the public domain; provided as is, without warranty of any kind", "Apache License 2.0.1", "LİCENSE", "é CC BY é",
        "neither the name of the owner may be used to endorse or promote products", "unlicense", None, "", "...", "ſ K cc0",
    ]
    check(spark, [(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0), (1, texts[0], 0), (1, texts[0], 0), (None, None, 1)])


def test_mixtures_of_rules(spark):
    rng = random.Random(6)
    parts = ["licensed under the", "apache license", "version", "2.0", "gnu", "general public license", "3", "cc by", "nc", "4.0", "all rights reserved"]
    parts += ["creative commons attribution", "public domain", "or any later version", "mit license", "word", "copyright 2020", "spdx license identifier", "mit"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    check(spark, [(i, t, 0) for i, t in enumerate(texts)])


def test_whole_table(spark, root):
    rows = ds.dataset(f"{root}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: tuple(r) for r in licenses.op8_license_scan(spark, root).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == (r["doc_id"], *plain(r["text"]))


def test_long_and_empty(spark):
    text = "the mit license. " * 4_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = licenses.scan(docs).collect()
    assert (row.n_words, row.labels, len(row.detections)) == (12_000, "mit", 4_000)
    assert licenses.scan(docs.limit(0)).count() == 0
