"""Token counts of documents without their ids: pieces are counted once per distinct pre-token."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import slices
from lorespan.llm.tokens import _ENDS, _SAFE_SPACE, _Memory, _plain, encoder, evenly_spaced

#: Documents and bytes of text that share a block; a block's pre-tokens are listed once with their frequencies.
BLOCK_ROWS = 20_000
BLOCK_BYTES = 32 << 20
#: Hash values of pre-tokens that share a row, and the byte between them.
BUCKETS = 4096
SEPARATOR = b"\xff"


class _PreTokens:
    """Pre-tokens of texts as numbers of a list that grows with the block."""

    def __init__(self, vocabulary: str):
        self.enc = encoder(vocabulary)
        self.pre = self.enc.lib.pre_tokenizer
        self.special = re.compile("(" + "|".join(map(re.escape, self.enc.special)) + ")") if self.enc.special else None
        self.fresh()

    def fresh(self) -> None:
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.pieces = _Memory(self._piece)
        self.spaced = _Memory(lambda p: self._piece(" " + p))

    def _name(self, token: str) -> int:
        n = self.number.get(token)
        if n is None:
            n = self.number[token] = len(self.names)
            self.names.append(token)
        return n

    def _piece(self, piece: str) -> tuple[int, ...]:
        lead, word = (" ", piece[1:]) if piece[:1] == " " else ("", piece)
        if "\n" not in word and len(word) > 1 and word[-1] in _ENDS and _plain(word[:-1]):
            return self._name(lead + word[:-1]), self._name(word[-1])
        if word and _plain(word):
            return (self._name(piece),)
        text = self.enc.lib.normalizer.normalize_str(piece) if self.enc.lib.normalizer else piece
        found = []
        for _, (i, j) in self.pre.pre_tokenize_str(text):
            # Letters of several bytes share an offset where the scheme splits bytes; a pre-token is never empty.
            found.append(self._name(text[i:j]))
        return tuple(found)

    def of(self, text: str) -> list[tuple[int, ...]]:
        if self.special and self.special.search(text):
            found = []
            for k, part in enumerate(self.special.split(text)):
                if part:
                    found.append((self._name(part),) if k % 2 else self._piece(part))
            return found
        head, *rest = text.split(" ")
        if evenly_spaced(text):
            return [self.pieces[head], *map(self.spaced.__getitem__, rest)]
        head, *rest = _SAFE_SPACE.split(text)
        return [self.pieces[head], *(self.pieces[" " + r] for r in rest)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for batch, values in slices(batches, "t"):
        ids += batch.column("id").to_pylist()
        texts += values
        size += sum(len(v) for v in values if v)
        if len(ids) >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pre_token_postings(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per-document pre-token frequencies, as ``bucket, block, words, entries, at, times, ids, n_bytes``.

    A block is a run of documents of one input split, a bucket holds the pre-tokens of a hash value. Their row has the
    distinct pre-tokens (``words``, joined by a byte that UTF-8 never uses) and for each of them the number of its
    entries: positions of documents in the block (``at``, 16 bits) and frequencies there (``times``, 8 bits; larger
    ones are repeated entries). One more row per block lists the documents.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pre = TaskContext.get().partitionId() << 32, _PreTokens(vocabulary)
        for number, (ids, texts) in enumerate(_blocks(batches)):
            pre.fresh()
            words, docs_at, counts, sizes = [], [], [], []
            for at, t in enumerate(texts):
                sizes.append(len(t.encode()) if t else 0)
                found = [w for piece in pre.of(t) for w in piece] if t else []
                own, times = np.unique(np.array(found, dtype=np.int32), return_counts=True)
                while len(own):
                    words.append(own)
                    docs_at.append(np.full(len(own), at, np.uint16))
                    counts.append(np.minimum(times, 255).astype(np.uint8))
                    own, times = own[times > 255], times[times > 255] - 255
            block = split + number
            yield _postings_batch([block % BUCKETS], [block], *[[None]] * 4, [ids], [sizes])
            if not words:
                continue
            names = [w.encode() for w in pre.names]
            bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % BUCKETS
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            key = rank[np.concatenate(words)]
            by_word = np.argsort(key, kind="stable")
            at, times = np.concatenate(docs_at)[by_word], np.concatenate(counts)[by_word]
            entries = np.bincount(key, minlength=len(order)).astype("<u4")
            del words, docs_at, counts, key, by_word
            held, cut = np.unique(bucket[order], return_index=True)
            cut = np.append(cut, len(order)).tolist()
            ends = np.concatenate([[0], np.cumsum(entries, dtype=np.int64)])[cut].tolist()
            runs = list(zip(cut, cut[1:], ends, ends[1:]))
            yield _postings_batch(
                held,
                [block] * len(held),
                [SEPARATOR.join([names[k] for k in order[i:j]]) for i, j, _, _ in runs],
                [entries[i:j].tobytes() for i, j, _, _ in runs],
                [at[i:j].astype("<u2").tobytes() for _, _, i, j in runs],
                [times[i:j].tobytes() for _, _, i, j in runs],
                [None] * len(held),
                [None] * len(held),
            )

    return rows.mapInArrow(
        run,
        "bucket int, block long, words binary, entries binary, at binary, times binary, ids array<long>, n_bytes array<long>",
    )


def _postings_batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["bucket", "block", "words", "entries", "at", "times", "ids", "n_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _count_pieces(vocabulary: str) -> _Memory:
    enc = encoder(vocabulary)

    def count(word: bytes) -> int:
        token = word.decode()
        if enc.keeps_space and _plain(token.removeprefix(" ")):
            return len(enc.model.tokenize(enc.as_letters(token)))
        return len(enc.lib.encode(token, add_special_tokens=False).ids)

    return _Memory(count)


def block_sums(postings: DataFrame, vocabulary: str) -> DataFrame:
    """Tokens of each block's documents that lie in the pre-tokens of one partition, as ``block, at, sums, ids, n_bytes``.

    All rows of a pre-token meet in one partition; its pieces are counted there once and joined to every frequency.
    Rows come block by block, so a task holds one block's sums and the counts of its own pre-tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _count_pieces(vocabulary)
        block, docs, amounts = None, [], []

        def done() -> pa.RecordBatch:
            total = np.bincount(np.concatenate(docs), np.concatenate(amounts)).astype("<u4")
            at = np.flatnonzero(total)
            total = total[at]
            packed = total.astype(np.min_scalar_type(total.max()) if len(total) else np.uint8)
            return _sums_batch([block], [at.astype("<u2").tobytes()], [packed.tobytes()], [None], [None])

        for batch in batches:
            columns = [batch.column(c) for c in ("block", "words", "entries", "at", "times")]
            for i, row in enumerate(zip(*columns)):
                number, words, entries, at, times = (x.as_py() for x in row)
                if words is None:
                    yield _sums_batch([number], [None], [None], [batch.column("ids")[i].as_py()], [batch.column("n_bytes")[i].as_py()])
                    continue
                if number != block:
                    if docs:
                        yield done()
                    block, docs, amounts = number, [], []
                each = np.fromiter(map(pieces.__getitem__, words.split(SEPARATOR)), np.int64)
                docs.append(np.frombuffer(at, "<u2").astype(np.int64))
                amounts.append(np.repeat(each, np.frombuffer(entries, "<u4")) * np.frombuffer(times, np.uint8))
        if docs:
            yield done()

    dealt = postings.repartition("bucket").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "block long, at binary, sums binary, ids array<long>, n_bytes array<long>")


def _sums_batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["block", "at", "sums", "ids", "n_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    head = rows[rows["at"].isna()].iloc[0]
    total = np.zeros(len(head["ids"]), np.int64)
    for at, sums in zip(rows["at"], rows["sums"]):
        if at is not None:
            at = np.frombuffer(at, "<u2")
            total[at] += np.frombuffer(sums, f"<u{len(sums) // max(1, len(at))}")
    ids = pd.array([None if i is None or i != i else int(i) for i in head["ids"]], dtype="Int64")
    return pd.DataFrame({"id": ids, "n_bytes": np.asarray(head["n_bytes"], np.int64), "n_tokens": total})


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row.

    Distinct pre-tokens are counted once each and joined to the per-document frequencies; what travels are packed
    arrays per block of documents, so a frequent pre-token has an entry per block and document, and no row. Null and empty
    texts have no tokens; repeated rows are counted each; null ids stay null.
    """
    parts = block_sums(pre_token_postings(docs, vocabulary, id, text), vocabulary)
    total = parts.groupBy("block").applyInPandas(_total, "id long, n_bytes long, n_tokens long")
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return total.select(F.col("id").alias(id), "n_bytes", "n_tokens", over)


def op4_token_counts(spark, root: str, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(spark.read.parquet(f"{root}/documents.parquet"), vocabulary, limit)
