"""Packing of documents into token sequences: a configuration linear program over the histogram of lengths."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import arrow_step, stored
from lorespan.llm.tokens import encoder

CAPACITY = 2048
#: Rounds of the multiplicative weights, their step, and how far from the best a pattern may price.
ROUNDS = 120
STEP = 0.5
SLACK = 0.02
#: Parts that the pieces of a length are dealt to for numbering.
DEAL = 1024

Pattern = tuple[int, ...]


def _knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every capacity with any number of each length, and the length taken last (0: leave a gap)."""
    size = len(price)
    value, last = np.zeros(size), np.zeros(size, np.int64)
    backward = np.zeros(2 * size)  # value, back to front, so that both operands are contiguous
    for c in range(1, size):
        options = backward[2 * size - c : 2 * size] + price[1 : c + 1]
        k = int(options.argmax())
        if options[k] > value[c - 1]:
            value[c], last[c] = options[k], k + 1
        else:
            value[c] = value[c - 1]
        backward[2 * size - 1 - c] = value[c]
    return value, last


def configuration_lp(need: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[Pattern, float], float]:
    """A fractional cover of ``need[length]`` pieces by patterns that fit ``len(need) - 1``, and a lower bound.

    Lengths have prices. Pricing solves a knapsack over all capacities at once; for every length, the table also gives
    the best pattern that holds it, and those within ``SLACK`` of the best share the round by their unmet need. Prices
    of lengths covered above average then fall, the others rise. The patterns' mean over the rounds is the solution;
    prices scaled by the best pattern are a dual solution, which bounds the number of sequences from below.
    """
    capacity = len(need) - 1
    lengths = np.flatnonzero(need)
    weight = lengths / capacity
    total: dict[Pattern, float] = defaultdict(float)
    bound = 0.0
    covered = np.zeros(len(need))
    for turn in range(rounds):
        price = np.full(capacity + 1, -1.0)
        price[lengths] = weight
        value, last = _knapsack(price)
        bound = max(bound, float((need[lengths] * weight).sum() / value[capacity]))
        reach = weight + value[capacity - lengths]
        chosen = lengths[reach >= (1 - SLACK) * value[capacity]]
        share: dict[Pattern, float] = defaultdict(float)
        lack = np.maximum(need - covered / max(1, turn), need * 0.05)
        for l in chosen.tolist():
            pattern, room = [l], capacity - l
            while room > 0:
                if last[room]:
                    pattern.append(int(last[room]))
                    room -= int(last[room])
                else:
                    room -= 1
            share[tuple(sorted(pattern, reverse=True))] += lack[l]
        scale = bound / sum(share.values())
        cover = np.zeros(len(need))
        for pattern, mass in share.items():
            total[pattern] += mass * scale / rounds
            for l in pattern:
                cover[l] += mass * scale
        covered += cover
        rate = covered[lengths] / (turn + 1) / need[lengths]
        now = cover[lengths] / need[lengths]
        weight = weight * np.exp(-STEP * np.clip(0.5 * now + 0.5 * rate - 1, -1, 1))
        weight /= weight.max()
        weight = np.maximum(weight, 1e-6)
    return dict(total), bound


def _best_fit(need: np.ndarray, open_: dict[int, Counter]) -> None:
    """Put what is left into the sequences begun (by room, each pattern with its number), largest first."""
    capacity = len(need) - 1
    rooms = np.zeros(capacity + 1, bool)
    for room, patterns in open_.items():
        rooms[room] = bool(patterns)
    for l in range(capacity, 0, -1):
        n = int(need[l])
        while n:
            at = l + int(rooms[l:].argmax())
            if not rooms[at]:
                each = capacity // l
                for copies, k in ((each, n // each), (n % each, 1)):
                    if copies and k:
                        open_[capacity - copies * l][(l,) * copies] += k
                        rooms[capacity - copies * l] = True
                break
            pattern, have = next(iter(open_[at].items()))
            k = min(n, have)
            open_[at][pattern] -= k
            if open_[at][pattern] == 0:
                del open_[at][pattern]
                rooms[at] = bool(open_[at])
            open_[at - l][(*pattern, l)] += k
            rooms[at - l] = True
            n -= k


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[Pattern, int]], float]:
    """Patterns with the number of sequences that follow each, and the lower bound on that number.

    The solution of the program is rounded: patterns are taken by falling amount, each as often as its amount rounded
    down and as the pieces left allow; best fit puts the rest into open and new sequences. Every piece is used once.
    More documents leave less to it: the rest has at most as many pieces as the patterns have places.
    """
    need = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        need[length] = n
    full = int(need[capacity])
    need[capacity] = 0
    made: dict[int, Counter] = defaultdict(Counter)
    bound = 0.0
    if need.any():
        amounts, bound = configuration_lp(need, rounds)
        left = need.copy()
        for pattern, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
            copies = Counter(pattern)
            k = min(int(amount), *(int(left[l]) // c for l, c in copies.items()))
            if k > 0:
                made[capacity - sum(pattern)][pattern] += k
                for l, c in copies.items():
                    left[l] -= k * c
        _best_fit(left, made)
    out = [(p, k) for room in sorted(made) for p, k in made[room].items()]
    return ([((capacity,), full)] if full else []) + out, bound + full


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``id, piece, start, length, ids`` of every document: its ids and ``end_id``, cut every ``capacity`` ids.

    ``ids`` are little-endian unsigned 32-bit integers. A null text is empty, so each row has one piece at least.
    Repeated rows and null ids are documents like any other.
    """
    kind = docs.schema[id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def step(batch: pa.RecordBatch, texts: list[str | None]) -> list:
        enc = encoder(vocabulary)
        of, piece, start, ids = [], [], [], []
        for row, t in enumerate(texts):
            whole = enc.ids(t) + end
            for k, i in enumerate(range(0, len(whole), 4 * capacity)):
                of.append(row)
                piece.append(k)
                start.append(i // 4)
                ids.append(whole[i : i + 4 * capacity])
        length = pa.array([len(x) // 4 for x in ids], pa.int64())
        piece, start = pa.array(piece, pa.int32()), pa.array(start, pa.int64())
        return [batch.column("id").take(pa.array(of, pa.int64())), piece, start, length, pa.array(ids, pa.binary())]

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
    found = arrow_step(rows, "t", f"id {kind}, piece int, start long, length long, ids binary", step)
    return found.withColumnRenamed("id", id)


def _numbered(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_rank``, the number of a piece among those of its length, from 0.

    A length may hold a third of all pieces, so its pieces are dealt to ``DEAL`` parts by hash, numbered within them,
    and shifted by the counts of the parts before.
    """
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(DEAL)))
    counts = dealt.groupBy("length", "_part").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("length", "_part").orderBy(*order)
    return (
        dealt.withColumn("_rank", F.row_number().over(within) - 1)
        .join(shift, ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_shift"))
        .drop("_part", "_shift")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces with a ``length`` of 1 to ``capacity``; other columns stay.

    The pieces are read twice (for the histogram and for their places), so store them first. Only the histogram, one
    row per length, comes to the driver; the plan that goes back has at most a run for each place of the patterns,
    however many pieces there are. Pieces of a length are interchangeable and take the runs in the order of their
    number. An empty table stays empty.
    """
    histogram = {int(n): int(k) for n, k in pieces.groupBy("length").count().collect()}
    if histogram and not (min(histogram) >= 1 and max(histogram) <= capacity):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    patterns, _ = plan(histogram, capacity, rounds)
    runs, rank, sequence = [], Counter(), 0
    for pattern, k in patterns:
        offset = 0
        for length in pattern:
            runs.append((length << 48 | rank[length], sequence - rank[length], offset))
            rank[length] += k
            offset += length
        sequence += k
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)

    def place(batches):
        for batch in batches:
            key = batch.column("length").to_numpy() << 48 | batch.column("_rank").to_numpy()
            at = np.searchsorted(table[:, 0], key, side="right") - 1
            numbers = pa.array(batch.column("_rank").to_numpy() + table[at, 1])
            columns = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), numbers, pa.array(table[at, 2])], [*columns, "sequence_id", "offset"]
            )

    order = [c for c in pieces.columns if c != "length" and pieces.schema[c].dataType.typeName() not in ("map", "variant")]
    numbered = _numbered(pieces, order)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("_rank").schema.fields)
    return numbered.mapInArrow(place, kind + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 0) -> DataFrame:
    """All documents packed: a row per piece with its checksum and place."""
    pieces = token_pieces(docs, vocabulary, end_id)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(pieces, "pieces"))


def op2_best_fit_packing(spark, root: str) -> DataFrame:
    """Place of every piece of every document."""
    return packed_documents(spark.read.parquet(f"{root}/documents.parquet"))
