"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passage and test item."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import arrow_step, keyed, slices

SEED_WORDS = 3
MIN_SCORE = 0.6
#: Share of the documents up to which an n-gram is rare in any case.
RARE = 0.001
#: Items of fewer words count as found only where they stand whole.
SHORT_ITEM = 5
#: Words of test items that one pass over the documents looks for; more items take more passes.
BLOCK_WORDS = 200_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Stretches of text whose words a task remembers before it forgets all.
REMEMBER = 300_000
#: Cells of the alignment table of a group of passages.
CELLS = 1 << 20

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _Numbers(dict):
    """Numbers of the words of the items; 0 for any other word, which is not remembered."""

    def __missing__(self, word: str) -> int:
        return 0


class _Chunks(dict):
    """Word numbers of what stands between white space, for texts of one block of items; words never span more.

    A chunk of one word is that word's number; others are negative, one more than their place in ``lists``.
    """

    def __init__(self, numbers: _Numbers):
        super().__init__()
        self.numbers, self.lists = numbers, []

    def __missing__(self, chunk: str) -> int:
        found = [self.numbers[w] for w in words_of(chunk)]
        if len(found) == 1:
            code = found[0]
        else:
            self.lists.append(found)
            code = -len(self.lists)
        self[chunk] = code
        return code

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts, ``SEED_WORDS`` zeros after each, and where each text begins and ends."""
        if len(self) >= REMEMBER:
            self.clear()
            self.lists = []
        codes, ends = [], []
        for t in texts:
            if t:
                codes += map(self.__getitem__, t.split())
            codes += [0] * SEED_WORDS
            ends.append(len(codes))
        words = np.array(codes, np.int64)
        ends = np.array(ends, np.int64)
        odd = words < 0
        if odd.any():
            lists = [self.lists[-c - 1] for c in words[odd].tolist()]
            n = np.ones(len(words), np.int64)
            n[odd] = [len(x) for x in lists]
            until = np.cumsum(n)
            out = np.repeat(words, n)
            out[np.repeat(odd, n)] = list(chain.from_iterable(lists))
            words, ends = out, until[ends - 1]
        return words, np.append(0, ends[:-1]), ends - SEED_WORDS


class _Memory:
    """Travels to the tasks empty, and keeps a task's chunks from one slice to the next."""

    def __init__(self, numbers: _Numbers):
        self.numbers, self.kept = numbers, None

    def chunks(self) -> _Chunks:
        if self.kept is None:
            self.kept = _Chunks(self.numbers)
        return self.kept


@dataclass
class Items:
    """A block of test items as word numbers, and their n-grams by code."""

    ids: list
    words: list[np.ndarray]
    numbers: _Numbers
    grams: np.ndarray  # sorted distinct codes
    of_gram: np.ndarray  # gram, item and position of each place, sorted by gram
    sizes: list[int]

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        numbers = _Numbers()
        ids, words = [], []
        for item, text in rows:
            own = words_of(text)
            if own:
                ids.append(item)
                words.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in own], dtype=np.int64))
        items = Items(ids, words, numbers, np.zeros(0, np.int64), np.zeros((0, 3), np.int64), [])
        places = []
        for k, w in enumerate(words):
            n = min(SEED_WORDS, len(w))
            places += [(code, k, i) for i, code in enumerate(items.codes(w, n).tolist())]
        items.sizes = sorted({min(SEED_WORDS, len(w)) for w in words})
        if places:
            table = np.array(sorted(places), dtype=np.int64)
            items.grams, gram = np.unique(table[:, 0], return_inverse=True)
            items.of_gram = np.column_stack([gram, table[:, 1:]])
        return items

    def codes(self, words: np.ndarray, n: int) -> np.ndarray:
        """A number per run of ``n`` words; 0 where a word is not one of the items'. Runs of other lengths differ."""
        base = len(self.numbers) + 1
        if len(words) < n:
            return np.zeros(0, np.int64)
        code, known = words[: len(words) - n + 1].copy(), words[: len(words) - n + 1] > 0
        for i in range(1, n):
            nxt = words[i : len(words) - n + 1 + i]
            code, known = code * base + nxt, known & (nxt > 0)
        return np.where(known, code, 0)

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams of the items stand where in a text."""
        grams, places = [], []
        for n in self.sizes:
            codes = self.codes(words, n)
            at = np.flatnonzero(codes)
            k = np.searchsorted(self.grams, codes[at])
            hit = self.grams[np.minimum(k, len(self.grams) - 1)] == codes[at]
            grams.append(k[hit])
            places.append(at[hit])
        return (np.concatenate(grams), np.concatenate(places)) if grams else (np.zeros(0, np.int64),) * 2


def blocks_of(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[Items]:
    """Test items in blocks of a bounded number of words; the driver holds one block at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item), F.col(text).cast("string")).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(words_of(r[1]))
        if size >= block_words:
            yield Items.of(rows)
            rows, size = [], 0
    if rows:
        yield Items.of(rows)


def gram_frequencies(docs: DataFrame, items: Items, text: str) -> np.ndarray:
    """In how many documents each n-gram of the items stands, and last the number of documents; all of them count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunks = np.zeros(len(items.grams) + 1, np.int64), _Chunks(items.numbers)
        for _, texts in slices(batches, "t"):
            words, begins, _ = chunks.of(texts)
            grams, places = items.found(words)
            once = np.unique(np.searchsorted(begins, places, "right") * len(total) + grams)
            total += np.bincount(once % len(total), minlength=len(total))
            total[-1] += len(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "docs"])

    counts = docs.select(F.col(text).alias("t")).mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs"))
    out = np.zeros(len(items.grams) + 1, np.int64)
    for gram, n in counts.collect():  # a row per n-gram of the block at most
        out[gram] = n
    return out


def rare_seeds(items: Items, frequency: np.ndarray) -> np.ndarray:
    """Places of the n-grams that are rare in the corpus, or no more frequent than the median n-gram of their item.

    As rarity is relative to the item too, a passage that half of the corpus copies still has seeds.
    """
    rare = np.ceil(RARE * frequency[-1])
    of = items.of_gram
    keep = np.zeros(len(of), bool)
    order = np.argsort(of[:, 1], kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(of[order, 1])) + 1):
        f = frequency[of[own, 0]]
        keep[own] = f <= max(np.median(f), rare)
    return of[keep]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row of ``item`` with the same row of ``passage``: score, and where it ends.

    Rows are padded with -1 (items) and -2 (passages), which match nothing. A row of the table is one step for all
    pairs; gaps along the passage are a running maximum.
    """
    n, width = passage.shape
    slope = -GAP * np.arange(width, dtype=np.int32)
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(item.shape[1]):
        here = above[:, :-1] + np.where(passage == item[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        here = np.maximum(np.maximum(here, above[:, 1:] + GAP), 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        at = here.argmax(axis=1)
        top = here[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above[:, 1:] = here
    return best, end


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for row, words in zip(out, rows):
        row[: len(words)] = words
    return out


def _windows(
    items: Items, seeds_by_gram: np.ndarray, seeds: np.ndarray, grams: np.ndarray, places: np.ndarray, n_words: int
) -> list[tuple[int, int, int]]:
    """Stretches of a text to align: item, first word and last word (exclusive), around the diagonals of its seeds.

    ``grams`` of the items stand at ``places`` of the text of ``n_words`` words.
    """
    first, last = seeds_by_gram[grams], seeds_by_gram[grams + 1]
    times = last - first
    if not times.sum():
        return []
    rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    own = seeds[np.repeat(first, times) + rank]
    pairs = np.unique(np.column_stack([own[:, 1], np.repeat(places, times) - own[:, 2]]), axis=0)
    out = []
    for item, diagonal in pairs.tolist():
        size = len(items.words[item])
        pad = max(4, size // 4)
        begin, stop = max(0, diagonal - pad), min(n_words, diagonal + size + pad)
        if out and out[-1][0] == item and begin <= out[-1][2] - size:
            out[-1] = (item, out[-1][1], stop)
        else:
            out.append((item, begin, stop))
    return out


def _aligned(items: Items, jobs: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, float, int, int]]:
    """Score, first and last word of every job (item, first word, passage) in order."""
    out: list = [None] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda j: (len(items.words[jobs[j][0]]), len(jobs[j][2])))
    at = 0
    while at < len(order):
        group, width = [], 0
        while at < len(order) and (not group or max(width, len(jobs[order[at]][2])) * (len(group) + 1) <= CELLS):
            width = max(width, len(jobs[order[at]][2]))
            group.append(order[at])
            at += 1
        own, passages = [items.words[jobs[j][0]] for j in group], [jobs[j][2] for j in group]
        best, end = align(_padded(own, -1), _padded(passages, -2))
        score = best / (MATCH * np.array([len(w) for w in own]))
        hit = np.flatnonzero(score >= np.where([len(w) < SHORT_ITEM for w in own], 1.0, 0.0))
        heads = [passages[k][: end[k] + 1][::-1] for k in hit]
        back = align(_padded([own[k][::-1] for k in hit], -1), _padded(heads, -2))[1] if len(hit) else []
        for k, b in zip(hit.tolist(), back):
            out[group[k]] = (float(score[k]), int(jobs[group[k]][1] + end[k] - b), int(jobs[group[k]][1] + end[k]))
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_score: float = MIN_SCORE,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``id, item, score, first_word, last_word`` of every document and test item that align well enough.

    Words are lower-cased runs of letters and digits. Seeds are those word trigrams of an item that few
    documents hold, or no more than hold the item's median one. Around the diagonals of a document's seeds, item and passage are
    aligned; the score is the alignment's over that of a whole copy. The best passage of a pair is given, by word
    positions; of equal ones, the first.

    Null and empty texts on either side find nothing; ids may be null; repeated rows are searched each.
    """
    kind, item_kind = docs.schema[id].dataType.simpleString(), benchmark.schema[item].dataType
    schema = f"id {kind}, item int, score double, first_word long, last_word long"
    spark, found = docs.sparkSession, []
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
    for items in blocks_of(benchmark, item, item_text, block_words):
        if not items.ids:
            continue
        seeds = rare_seeds(items, gram_frequencies(docs, items, text))
        by_gram = np.searchsorted(seeds[:, 0], np.arange(len(items.grams) + 1))

        memory = _Memory(items.numbers)

        def step(
            batch: pa.RecordBatch, texts: list[str | None], items=items, seeds=seeds, by_gram=by_gram, memory=memory
        ) -> list:
            jobs, of = [], []
            words, begins, ends = memory.chunks().of(texts)
            grams, places = items.found(words)
            seed = by_gram[grams + 1] > by_gram[grams]
            grams, places = grams[seed], places[seed]
            text_of = np.searchsorted(begins, places, "right") - 1
            order = np.argsort(text_of, kind="stable")
            grams, places, text_of = grams[order], places[order], text_of[order]
            some, cuts = np.unique(text_of, return_index=True)
            for row, i, j in zip(some.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(text_of)]):
                begin_, end_ = int(begins[row]), int(ends[row])
                own = words[begin_:end_]
                for k, begin, stop in _windows(items, by_gram, seeds, grams[i:j], places[i:j] - begin_, len(own)):
                    jobs.append((k, begin, own[begin:stop]))
                    of.append(row)
            best: dict[tuple[int, int], tuple] = {}
            for row, job, hit in zip(of, jobs, _aligned(items, jobs)):
                if hit and hit[0] >= min_score and hit[0] > best.get((row, job[0]), (0,))[0]:
                    best[row, job[0]] = hit
            at = pa.array([row for row, _ in best], pa.int64())
            values = list(zip(*best.values())) or [[], [], []]
            kinds = (pa.float64(), pa.int64(), pa.int64())
            numbers = pa.array([k for _, k in best], pa.int32())
            return [batch.column("id").take(at), numbers, *(pa.array(v, t) for v, t in zip(values, kinds))]

        hits = arrow_step(rows, "t", schema, step)
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, name {item_kind.simpleString()}")
        hits = hits.join(F.broadcast(names), "item")  # at most block_words rows
        found.append(hits.select(F.col("id").alias(id), F.col("name").alias(item), "score", "first_word", "last_word"))
    if not found:
        empty = f"`{id}` {kind}, `{item}` {item_kind.simpleString()}, score double, first_word long, last_word long"
        return spark.createDataFrame([], empty)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold no test item. The decision falls on rows: of equal or missing ids, each by its own text."""
    table, _, own_text = keyed(docs, id, text)
    rows = table.select(F.struct("k", "l").alias("key"), F.col(own_text).alias("t"))
    leaks = contaminated(rows, benchmark, id="key", text="t").select("key.k", "key.l").distinct()
    out = table.join(leaks, ["k", "l"], "left_anti")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10_benchmark_decontamination(spark, root: str) -> DataFrame:
    """Every document and test item that align, over all documents and items."""
    benchmark = spark.read.parquet(f"{root}/benchmark.parquet")
    return contaminated(spark.read.parquet(f"{root}/documents.parquet"), benchmark)
