"""Token ids in patched frame-of-reference files: written in shards by the executors, read back block by block.

A shard holds the ids of a range of documents, one after another:

    magic | block ... block | block starts | null flags, document ids, ids per document | footer | magic

A block covers ``BLOCK`` ids (the last one of a shard fewer). Its smallest id is subtracted, the differences are
packed at the width that ``PERCENT`` of them fit in, and the others leave their high bits in an exception list.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import slices, stored
from lorespan.llm.tokens import encoder
from lorespan.session import scratch_path

BLOCK = 128
PERCENT = 90
MAGIC = b"PFORIDS1"
#: count of ids, smallest id, width in bits, count of exceptions
HEAD = np.dtype([("n", "u1"), ("low", "<u4"), ("width", "u1"), ("odd", "u1")])
#: blocks, documents, offset of the block starts
FOOT = struct.Struct("<qqq")
#: Blocks that are packed or unpacked at a time.
WINDOW = 1024


def _widths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray) -> list[bytes]:
    """The blocks of an array of unsigned 32-bit ids."""
    if not len(ids):
        return []
    n_blocks = -(-len(ids) // BLOCK)
    rows = np.full(n_blocks * BLOCK, ids[-1], dtype=np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    at = -(-PERCENT * BLOCK // 100) - 1
    width = _widths(np.partition(rows, at, axis=1)[:, at])
    # A shift by all 32 bits is not defined, and leaves nothing.
    high = np.where(width[:, None] < 32, rows >> np.minimum(width, 31)[:, None].astype(np.uint32), 0)
    odd = high > 0
    n_odd = odd.sum(axis=1)
    head = np.zeros(n_blocks, HEAD)
    head["n"], head["low"], head["width"], head["odd"] = BLOCK, low, width, n_odd
    head["n"][-1] = len(ids) - (n_blocks - 1) * BLOCK
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        cell = np.dtype("<u2" if w <= 16 else "<u4")
        whole = rows[own].astype(cell).view(np.uint8).reshape(len(own), -1)
        bits = np.unpackbits(whole, axis=1, bitorder="little").reshape(len(own), BLOCK, -1)[:, :, :w]
        body = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        for i, b in zip(own.tolist(), body):
            packed[i] = b.tobytes()
    where, place = np.nonzero(odd)
    place, high = place.astype(np.uint8), high[odd].astype("<u4")
    end = np.cumsum(n_odd).tolist()
    raw = head.tobytes()
    out = []
    first = 0
    for i, last in enumerate(end):
        lead = raw[i * HEAD.itemsize : (i + 1) * HEAD.itemsize]
        out.append(lead + packed[i] + place[first:last].tobytes() + high[first:last].tobytes())
        first = last
    return out


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` within ``data``."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD)[:, 0]
    width, n_odd = head["width"].astype(np.int64), head["odd"].astype(np.int64)
    rows = np.zeros((len(starts), BLOCK), np.uint32)
    body = starts + HEAD.itemsize
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(raw[body[own][:, None] + np.arange(BLOCK * w // 8)], axis=1, bitorder="little")
        cell = np.dtype("<u2" if w <= 16 else "<u4")
        whole = np.zeros((len(own), BLOCK, 8 * cell.itemsize), np.uint8)
        whole[:, :, :w] = bits.reshape(len(own), BLOCK, w)
        rows[own] = np.packbits(whole.reshape(len(own), -1), axis=1, bitorder="little").view(cell)
    if n_odd.sum():
        of = np.repeat(np.arange(len(starts)), n_odd)
        rank = np.arange(len(of)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
        place = body[of] + BLOCK * width[of] // 8
        high = place + n_odd[of] - rank + 4 * rank
        place = raw[place + rank]
        high = raw[(high + rank)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        rows[of, place] |= high << width[of].astype(np.uint32)
    rows += head["low"][:, None]
    keep = np.arange(BLOCK) < head["n"][:, None]
    return rows[keep]


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


class _Shard:
    """One file in the making; ids that do not fill a window yet wait in memory."""

    def __init__(self, out):
        self.out, self.at, self.starts, self.docs, self.wait, self.waiting = out, len(MAGIC), [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * BLOCK * WINDOW:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.wait), "<u4")
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK * WINDOW):
            for block in pack(ids[i : min(full, i + BLOCK * WINDOW)]):
                self.starts.append(self.at)
                self.at += len(block)
                self.out.write(block)
        self.wait = [ids[full:].tobytes()]
        self.waiting = len(self.wait[0])

    def close(self) -> int:
        self.flush(True)
        self.out.write(np.array(self.starts, "<i8").tobytes())
        self.out.write(np.array([d is None for d, _ in self.docs], np.uint8).tobytes())
        self.out.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self.out.write(np.array([n for _, n in self.docs], "<i8").tobytes())
        self.out.write(FOOT.pack(len(self.starts), len(self.docs), self.at) + MAGIC)
        return sum(n for _, n in self.docs)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every text, each document followed by ``end_id``, in ascending id order below ``path``.

    Returns the manifest, a row per shard: ``shard, file, docs, ids, start`` (ids in the shards before it). Each task
    writes its range of ids under a name of its own attempt and then renames it, so a repeated task leaves the same
    file. Null texts count as empty; null ids come first; rows of equal id are ordered by their text's hash.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(path)
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.ids"
        draft = posixpath.join(root, f"_{name}-{task.taskAttemptId()}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(draft) as out:
            shard = _Shard(out)
            for batch, texts in slices(batches, "t"):
                for doc_id, t in zip(batch.column("id").to_pylist(), texts):
                    shard.add(doc_id, enc.ids(t) + end)
            n = shard.close()
        fs.move(draft, posixpath.join(root, name))
        values = [[task.partitionId()], [name], [len(shard.docs)], [n]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["shard", "file", "docs", "ids"])

    made = stored(rows.mapInArrow(run, "shard long, file string, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class ShardReader:
    """Random and sequential access to one shard."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(FOOT.size + len(MAGIC), size - FOOT.size - len(MAGIC))
        n_blocks, n_docs, at = FOOT.unpack(tail[: FOOT.size])
        if tail[FOOT.size :] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a shard of ids")
        index = file.read_at(size - FOOT.size - len(MAGIC) - at, at)
        self.starts = np.append(np.frombuffer(index, "<i8", n_blocks), at)
        null = np.frombuffer(index, np.uint8, n_docs, 8 * n_blocks)
        ids = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks + n_docs)
        self.doc_ids = [None if z else d for z, d in zip(null.tolist(), ids.tolist())]
        self.lengths = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks + 9 * n_docs)

    def blocks(self, first: int, last: int) -> np.ndarray:
        starts = self.starts[first : last + 1]
        if first >= last:
            return np.zeros(0, np.uint32)
        return unpack(self.file.read_at(int(starts[-1] - starts[0]), int(starts[0])), starts[:-1] - starts[0])

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from the blocks that hold them alone."""
        start = int(self.lengths[:k].sum())
        stop = start + int(self.lengths[k])
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """Every document with the runs of its ids, in file order; a run is never longer than a window."""
        window, at, block = np.zeros(0, np.uint32), 0, 0
        for doc_id, length in zip(self.doc_ids, self.lengths.tolist()):
            runs = []
            while length:
                if at == len(window):
                    last = min(block + WINDOW, len(self.starts) - 1)
                    window, at, block = self.blocks(block, last), 0, last
                run = window[at : at + length]
                at, length = at + len(run), length - len(run)
                runs.append(run)
            yield doc_id, runs


def read_ids(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids`` as bytes) of every document, from the shards of ``path``."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(path)

        def rows():
            for batch in batches:
                for shard in batch.to_pylist():
                    with fs.open_input_file(posixpath.join(root, shard["file"])) as f:
                        start = shard["start"]
                        for doc_id, runs in ShardReader(f).documents():
                            crc, n = 0, 0
                            for r in runs:
                                crc, n = zlib.crc32(r.astype("<u4"), crc), n + len(r)
                            yield (doc_id, start, n, crc, b"".join(r.astype("<u4").tobytes() for r in runs) if with_ids else None)
                            start += n

        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64()] * 4 + [pa.binary()] * with_ids
        block = []

        def made(block):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names)

        for row in rows():
            block.append(row)
            if len(block) == (64 if with_ids else 5_000):
                yield made(block)
                block = []
        if block:
            yield made(block)

    # By number, so that the few rows of the manifest are not brought back together.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartitionByRange(tasks, "shard").mapInArrow(run, kind)


def op5_token_id_blocks(spark, root: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Every document's place, count and checksum as read back from the files."""
    path = scratch_path(spark, "ids")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    return read_ids(write_ids(docs, path, vocabulary, end_id), path)
