"""License scans: ordered signature rules behind keyword gates, as DataFrame expressions alone.

A text becomes its words, lower-cased (A-Z) and joined by single spaces, and rules are regular expressions over that.
A rule has a keyword that any text it matches holds, a level (1: a whole notice, 2: an identifier or a notice without
version, 3: a name with version, 4: a name, 5: general), and a weight. Detections are intervals. One that lies within
another of the same or a better level is suppressed; of equal intervals of a level, the rule listed first stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words; letters of either case belong to words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
LEVELS = 5


@dataclass(frozen=True)
class Rule:
    label: str
    level: int
    keyword: str
    pattern: str
    weight: float


#: Label, keyword, name, short identifier, versions.
FAMILIES = (
    ("apache", "apache", "apache(?: software)? licen[cs]e", "apache", ("1 0", "1 1", "2 0")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "agpl", ("1 0", "3 0", "3")),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", "gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", "gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[cs]e", "epl", ("1 0", "2 0")),
    ("cpl", "common public", "common public licen[cs]e", "cpl", ("1 0",)),
    ("ipl", "ibm", "ibm public licen[cs]e", "ipl", ("1 0",)),
    ("cddl", "common development", "common development and distribution licen[cs]e", "cddl", ("1 0", "1 1")),
    ("eupl", "european union", "european union public licen[cs]e", "eupl", ("1 0", "1 1", "1 2")),
    ("osl", "open software", "open software licen[cs]e", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("afl", "academic free", "academic free licen[cs]e", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", "(?:clarified )?artistic licen[cs]e", "artistic", ("1 0", "2 0")),
    ("bsl-boost", "boost", "boost software licen[cs]e", "bsl", ("1 0",)),
    ("busl", "business source", "business source licen[cs]e", "busl", ("1 0", "1 1")),
    ("sspl", "server side", "server side public licen[cs]e", "sspl", ("1 0", "1")),
    ("elastic", "elastic", "elastic licen[cs]e", "elastic", ("1 0", "2 0")),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", "ofl", ("1 0", "1 1")),
    ("psf", "python", "python software foundation licen[cs]e", "psf", ("2 0", "2")),
    ("php", "php", "php licen[cs]e", "php", ("3 0", "3 01")),
    ("zpl", "zope", "zope public licen[cs]e", "zpl", ("1 1", "2 0", "2 1")),
    ("lppl", "latex", "latex project public licen[cs]e", "lppl", ("1 0", "1 1", "1 2", "1 3")),
    ("ecl", "educational", "educational community licen[cs]e", "ecl", ("1 0", "2 0")),
    ("upl", "universal permissive", "universal permissive licen[cs]e", "upl", ("1 0",)),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", "ms pl", ()),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", "ms rl", ()),
    ("apsl", "apple public", "apple public source licen[cs]e", "apsl", ("1 0", "1 1", "1 2", "2 0")),
    ("nasa", "nasa", "nasa open source agreement licen[cs]e", "nasa", ("1 3",)),
    ("cecill", "cecill", "cecill(?: free software)? licen[cs]e", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("odbl", "open database", "open database licen[cs]e", "odbl", ("1 0",)),
    ("odc-by", "open data commons", "open data commons attribution licen[cs]e", "odc by", ("1 0",)),
    ("blueoak", "blue oak", "blue oak model licen[cs]e", "blueoak", ("1 0 0",)),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield) licen[cs]e", "polyform", ("1 0 0",)),
    ("qpl", "q public", "q public licen[cs]e", "qpl", ("1 0",)),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", "sleepycat", ()),
    ("mit", "mit", "(?:mit|expat|x11) licen[cs]e", "mit", ()),
    ("bsd-2", "bsd", "(?:bsd (?:2|two) clause|simplified bsd|freebsd) licen[cs]e", "bsd 2 clause", ()),
    ("bsd-3", "bsd", "(?:bsd (?:3|three) clause|new bsd|modified bsd|revised bsd) licen[cs]e", "bsd 3 clause", ()),
    ("bsd-4", "bsd", "(?:bsd (?:4|four) clause|original bsd) licen[cs]e", "bsd 4 clause", ()),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "bsd", ()),
    ("isc", "isc", "isc licen[cs]e", "isc", ()),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib", ()),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", "ncsa", ()),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql", ()),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl", ()),
    ("curl", "curl", "curl licen[cs]e", "curl", ()),
    ("ruby", "ruby", "ruby licen[cs]e", "ruby", ()),
    ("w3c", "w3c", "w3c software(?: notice and)? licen[cs]e", "w3c", ()),
    ("json", "json", "json licen[cs]e", "json", ()),
    ("unlicense", "unlicen", "unlicen[cs]e", "unlicense", ()),
    ("wtfpl", "wtf", "do what the f[a-z]* you want to public licen[cs]e", "wtfpl", ("2",)),
)

#: Sentences of license texts and general notices: label, level, keyword, pattern, weight.
SENTENCES = (
    ("mit", 1, "hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?", 1.0),
    ("bsd", 1, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd-3", 1, "neither the name", "neither the name of .{1,80}? may be used to endorse or promote products", 0.9),
    ("isc", 1, "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose", 1.0),
    ("zlib", 1, "altered source versions", "altered source versions must be plainly marked as such", 0.9),
    ("gpl", 1, "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("lgpl", 1, "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    ("gnu-text", 1, "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document", 0.9),
    ("apache", 1, "you may not use this file", "you may not use this file except in compliance with the license", 0.8),
    ("mpl", 1, "mozilla", "this source code form is subject to the terms of the mozilla public license", 1.0),
    ("unlicense", 1, "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("disclaimer", 4, "provided as is", "(?:the|this) (?:software|program|work|library) is provided as is", 0.4),
    ("disclaimer", 4, "warrant", "without (?:any )?warrant(?:y|ies)(?: of any kind)?", 0.3),
    ("public-domain", 3, "public domain", "(?:released (?:in)?to|placed (?:in)?to|dedicated to|part of|in) the public domain", 0.7),
    ("public-domain", 4, "public domain", "public domain", 0.4),
    ("copyright", 5, "copyright", "copyright (?:c )?(?:[12][0-9]{3} )+by", 0.4),
    ("copyright", 5, "copyright", "copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})*", 0.4),
    ("copyright", 5, "copyright", "copyright(?: c| notice)?", 0.2),
    ("reserved", 5, "rights reserved", "(?:all|some|no) rights reserved", 0.5),
    ("license-reference", 5, "licen", "(?:licensed|released|distributed|available|published|provided) under(?: the)?(?: terms of)?", 0.2),
    ("license-reference", 5, "licen", "see (?:the )?(?:file )?licen[cs]e(?: file)?(?: txt| md)?(?: for details)?", 0.2),
    ("license-reference", 5, "licen", "(?:end user )?licen[cs]e agreement", 0.3),
    ("proprietary", 3, "proprietary", "(?:confidential and proprietary|proprietary and confidential|proprietary licen[cs]e)", 0.8),
    ("proprietary", 3, "unauthorized", "unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|work|document))?", 0.6),
)

_CC = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no derivat(?:ives|ive works)"}
_CC_KINDS = ("by nc sa", "by nc nd", "by sa", "by nc", "by nd", "by")
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_UNDER = "(?:licensed|released|distributed|available|published|provided|covered) under(?: the)?(?: terms of(?: the)?)? "
_LATER = "(?: only| or(?: at your option)?(?: any)? later(?: version)?)?"


def _rules() -> list[Rule]:
    """The rules in order: sentences, then notices, identifiers and names of every family and version."""
    out = [Rule(*s) for s in SENTENCES]
    for label, keyword, name, short, versions in FAMILIES:
        for v in versions:
            # A version does not end within a longer one.
            number = rf"(?: licen[cs]e)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?{v}(?! [0-9])"
            own = f"{label}-{v.replace(' ', '.')}"
            out.append(Rule(own, 1, keyword, f"{_UNDER}{name}{number}{_LATER}", 1.0))
            out.append(Rule(own, 2, f"identifier {short}", f"spdx licen[cs]e identifier {short} {v}(?! [0-9]){_LATER}", 1.0))
            out.append(Rule(own, 3, keyword, f"{name}{number}{_LATER}", 0.9))
        out.append(Rule(label, 2, keyword, f"{_UNDER}{name}", 0.9))
        out.append(Rule(label, 2, f"identifier {short}", f"spdx licen[cs]e identifier {short}", 0.9))
        out.append(Rule(label, 4, keyword, name, 0.7))
    for kind in _CC_KINDS:
        words = " ".join(f"(?:{p}|{_CC[p]})" for p in kind.split())
        names = (("creative commons", f"creative commons {words}"), (f"cc {kind}", f"cc {kind}"))
        for keyword, name in names:
            name = f"{name}(?: (?:international|unported|generic))?"
            for v in _CC_VERSIONS:
                own = f"cc-{kind.replace(' ', '-')}-{v.replace(' ', '.')}"
                out.append(Rule(own, 1, keyword, f"{_UNDER}{name}(?: licen[cs]e)?(?: version| v)? {v}(?! [0-9])", 1.0))
                out.append(Rule(own, 3, keyword, f"{name}(?: licen[cs]e)?(?: version| v)? {v}(?! [0-9])", 0.9))
            out.append(Rule(f"cc-{kind.replace(' ', '-')}", 4, keyword, name, 0.7))
    out.append(Rule("cc0", 3, "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9))
    return out


RULES = _rules()
#: A text without any of these holds no keyword of a rule, and so does one without a phrase that starts with "cc".
ANCHORS = (
    "licen", "copyright", "reserved", "cc0", "creative", "spdx", "public", "warrant", "provided", "redistribut", "permission",
    "permitted", "neither", "altered", "free software", "proprietary", "unauthorized", "unencumbered", "compliance", "source code",
)


def _gate(text: Column) -> Column:
    """Whether rules or base phrases can match. Lower-casing more than A-Z lets in more texts and never fewer."""
    low = F.lower(text)
    some = F.contains(low, F.lit("cc")) & low.rlike(rf"cc{BETWEEN}by")
    for a in ANCHORS:
        # The words of an anchor may be apart by more than a space.
        each = F.lit(True)
        for word in a.split():
            each &= F.contains(low, F.lit(word))
        some |= each
    return F.coalesce(some, F.lit(False))


def _words_in(text: Column) -> Column:
    """Words of a stretch in which a space stands before each."""
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _base(line: Column) -> list[Column]:
    """Number, first and last place of each base phrase in a line, as structs."""
    out = []
    for phrase, label in BASE.items():
        parts = F.split(line, f" {phrase}(?= )")
        n = F.size(parts) - 1
        before = F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda total, p: total + _words_in(p))
        last = before + (n - 1) * len(phrase.split())
        found = F.struct(F.lit(label).alias("label"), n.alias("n"), _words_in(parts[0]).alias("first"), last.alias("last"))
        out.append(F.when(n > 0, found))
    return out


def _detections(lines: DataFrame, key: list[str]) -> DataFrame:
    """Intervals of every rule in ``line``: ``key, rule, level, label, weight, start, stop``; a line per key."""
    rules = [
        F.struct(
            F.lit(i).alias("rule"),
            F.lit(r.level).alias("level"),
            F.lit(r.label).alias("label"),
            F.lit(r.weight).alias("weight"),
            F.lit(r.keyword).alias("keyword"),
            F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
        )
        for i, r in enumerate(RULES)
    ]
    passing = F.filter(F.array(*rules), lambda r: F.contains(F.col("line"), r["keyword"]))
    jobs = lines.select(*key, "line", F.explode(passing).alias("r")).select(*key, "line", "r.*")
    parts, hits = F.split("line", F.col("pattern")), F.regexp_extract_all("line", F.col("pattern"), F.lit(0))
    names = [*key, "rule", "level", "label", "weight"]
    jobs = jobs.select(*names, F.transform(parts, F.length).alias("gaps"), F.transform(hits, F.length).alias("hits"))
    # The gap after the last hit has no hit of its own.
    pairs = jobs.where("size(hits) > 0").select(*names, F.posexplode(F.arrays_zip("gaps", "hits")).alias("at", "x"))
    pairs = pairs.select(*names, "at", "x.gaps", "x.hits").where("hits is not null")
    run = Window.partitionBy(*key, "rule").orderBy("at")
    stop = F.sum(F.col("gaps") + F.col("hits")).over(run)
    return pairs.select(*names, (stop - F.col("hits")).alias("start"), stop.alias("stop"))


def _survivors(found: DataFrame, key: list[str]) -> DataFrame:
    """Detections not contained in one of the same or a better level.

    In the order of start, falling stop, level and rule, whatever contains an interval stands before it, so the
    largest stop so far of each level decides.
    """
    before = Window.partitionBy(*key).orderBy("start", F.desc("stop"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("level") <= n, F.col("stop"))).over(before).alias(f"reach{n}") for n in range(1, LEVELS + 1)]
    own = F.element_at(F.array(*[f"reach{n}" for n in range(1, LEVELS + 1)]), F.col("level"))
    return found.select("*", *reach).where(~F.coalesce(own >= F.col("stop"), F.lit(False))).select(*found.columns)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Word and base phrase counts, labels and score of every row of ``docs``.

    Returns ``id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``: places are word
    numbers from 0, labels are sorted and joined by commas, the score is the best weight of a surviving detection (0
    if there is none), and ``detections`` lists the survivors with their intervals in the text's words joined by
    spaces. Null and empty texts have no words and empty labels. Repeated rows get the same answer each.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", BETWEEN), "")
    line = F.concat(F.lit(" "), F.translate(F.array_join(words, " "), UPPER, LOWER), F.lit(" "))
    gated = F.when(_gate(F.col("t")), line)
    key = ["id", "print", "size"]
    rows = rows.select("id", F.xxhash64("t").alias("print"), F.length("t").alias("size"), F.size(words).alias("n_words"), gated.alias("line"))
    base = rows.select(*key, "n_words", F.array_compact(F.array(*_base(F.col("line")))).alias("base"))
    # Equal rows have equal detections: found once, and joined to each of them.
    lines = rows.where("line is not null").select(*key, "line").dropDuplicates(key)
    kept = _survivors(_detections(lines, key), key)
    item = F.struct("start", "stop", "label", "level", "weight")
    kept = kept.groupBy(*key).agg(
        F.collect_set("label").alias("found"), F.max("weight").alias("score"), F.sort_array(F.collect_list(item)).alias("detections")
    )
    kept = kept.withColumnsRenamed({k: f"_{k}" for k in key})
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")) & (F.col("size") == F.col("_size"))
    names = F.transform("base", lambda b: b["label"])
    all_names = F.array_distinct(F.concat(names, F.coalesce("found", F.array().cast("array<string>"))))
    places = {"first_word": F.array_min(F.transform("base", lambda b: b["first"])), "last_word": F.array_max(F.transform("base", lambda b: b["last"]))}
    return base.join(kept, on, "left").select(
        F.col("id").alias(id),
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("base", F.lit(0).cast("long"), lambda total, b: total + b["n"]).alias("n_base"),
        *[c.cast("long").alias(n) for n, c in places.items()],
        F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_names), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "detections",
    )


def op8_license_scan(spark, root: str) -> DataFrame:
    """Words, base phrases, labels and score of every document."""
    return scan(spark.read.parquet(f"{root}/documents.parquet")).drop("detections")
