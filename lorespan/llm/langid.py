"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import arrow_step, remembers, slices

DIMENSIONS = 4096
SEED = 7
UNKNOWN = "und"
#: Cosine below which a text is in none of the languages; vectors at random stay under it.
MIN_SCORE = 0.04
#: Languages that the profiles may have; more of them mean that the column does not hold languages.
MAX_LANGUAGES = 1_000
#: Trigram vectors that a worker remembers.
REMEMBER = 20_000


class _Space:
    """Letter vectors and the trigram vectors bound from them."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.fold = np.full(0x110000, -1, np.int32)
        self.letter = functools.cache(self._letter)
        self.known: dict[int, int] = {}
        self.vectors = np.zeros((1024, dimensions), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        """A random vector of -1 and 1, the same for a letter in every worker."""
        bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dimensions, dtype=np.int8)
        return 2 * bits - 1

    def folded(self, codes: np.ndarray) -> np.ndarray:
        """Lower-case code points of letters; 0 for everything else."""
        out = self.fold[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                c = chr(code)
                self.fold[code] = ord(c.lower()[0]) if c.isalpha() else 0
            out = self.fold[codes]
        return out

    def bound(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """A vector per trigram: the letters' vectors, permuted by place (rotated by 2, 1 and 0), multiplied."""
        names = ((first.astype(np.int64) << 21 | second) << 21 | third).tolist()
        if len(self.known) + len(names) > REMEMBER:
            self.known.clear()
        rows = np.empty(len(names), np.int64)
        for i, name in enumerate(names):
            row = self.known.get(name)
            if row is None:
                row = self.known[name] = len(self.known)
                if row == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros((1024, self.dimensions), np.int8)])
                a, b, c = self.letter(int(first[i])), self.letter(int(second[i])), self.letter(int(third[i]))
                self.vectors[row] = np.roll(a, 2) * np.roll(b, 1) * c
            rows[i] = row
        return self.vectors[rows].astype(np.float32)

    def bundles(self, texts: list[str | None], group: np.ndarray, n: int) -> np.ndarray:
        """The sum of trigram vectors of each of ``n`` groups of texts. A text without letters adds nothing.

        Runs of other characters count as one gap; trigrams with a gap in the middle are left out.
        """
        marked = [f"\n{t}\n" if t else "\n\n" for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(group, [len(m) for m in marked])
        x = self.folded(codes)
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x, owner = x[keep], owner[keep]
        letters, x = np.unique(x, return_inverse=True)
        size = len(letters)
        full = np.flatnonzero(x[1:-1] != (0 if letters[0] == 0 else -1))
        tri = (x[full].astype(np.int64) * size + x[full + 1]) * size + x[full + 2]
        owner = owner[full + 1]
        if not len(tri):
            return np.zeros((n, self.dimensions), np.float32)
        if size**3 <= 1 << 22:
            seen = np.zeros(size**3, np.int64)
            seen[tri] = 1
            names = np.flatnonzero(seen)
            seen[names] = np.arange(len(names))
            place = seen[tri]
        else:
            names, place = np.unique(tri, return_inverse=True)
        out = np.zeros((n, self.dimensions), np.float32)
        for i in range(0, len(names), 1_024):  # few at a time, for the size of their vectors
            part = names[i : i + 1_024]
            own = (place >= i) & (place < i + len(part)) if len(names) > len(part) else slice(None)
            counts = np.bincount(owner[own] * len(part) + place[own] - i, minlength=n * len(part)).reshape(n, len(part))
            a, b, c = part // size**2, part // size % size, part % size
            out += counts.astype(np.float32) @ self.bound(letters[a], letters[b], letters[c])
        return out


_spaces = functools.cache(_Space)


def _space(dimensions: int, seed: int) -> _Space:
    """One space per worker process, as long as it serves this kind of step."""
    remembers("letters", _spaces.cache_clear)
    return _spaces(dimensions, seed)


def profiles(
    labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED
) -> dict[str, np.ndarray]:
    """A prototype per language: the bundle of the trigrams of all its texts, scaled to length one.

    Tasks add up their texts and hand on a vector per language; vectors are added up by Spark, dimension by dimension.
    The driver gets languages times dimensions numbers. Rows without a language are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = _space(dimensions, seed), {}
        for batch, texts in slices(batches, "t"):
            names, group = np.unique(np.array(batch.column("l").to_pylist(), dtype=object), return_inverse=True)
            for name, bundle in zip(names, space.bundles(texts, group, len(names))):
                total[name] = total.get(name, 0) + bundle.astype(np.float64)
        vectors = pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), vectors], ["l", "v"])

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    parts = rows.mapInArrow(run, "l string, v array<double>").select("l", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("l", "i").agg(F.sum("x").alias("x")).limit(dimensions * MAX_LANGUAGES + 1).collect()
    if len(sums) > dimensions * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found: dict[str, np.ndarray] = {}
    for name, i, x in sums:
        found.setdefault(name, np.zeros(dimensions))[i] = x
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def _nearest(known: dict[str, np.ndarray], dimensions: int, seed: int):
    """A function from texts to predicted names and scores."""
    names = [*known, UNKNOWN]
    matrix = np.array([known[n] for n in names[:-1]], dtype=np.float32).reshape(-1, dimensions)

    def nearest(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not len(matrix):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bundle = _space(dimensions, seed).bundles(texts, np.arange(len(texts)), len(texts))
        norm = np.linalg.norm(bundle, axis=1)
        cosine = bundle @ matrix.T / np.maximum(norm, 1e-9)[:, None]
        best = np.where(norm > 0, cosine.argmax(axis=1), len(names) - 1)
        score = np.where(norm > 0, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64)
        return [names[b] for b in best], score

    return nearest


def predict(
    docs: DataFrame,
    known: dict[str, np.ndarray],
    id: str = "doc_id",
    text: str = "text",
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> DataFrame:
    """``id, lang_pred, score`` of every row: the nearest prototype and its cosine (at least 0).

    Null texts, texts without letters, and all texts if nothing is known: ``und`` and 0. A tie goes to the name that
    sorts first.
    """
    kind = docs.schema[id].dataType.simpleString()
    nearest = _nearest(known, dimensions, seed)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
    found = arrow_step(rows, "t", f"id {kind}, lang_pred string, score double", lambda batch, t: [batch.column("id"), *nearest(t)])
    return found.withColumnRenamed("id", id)


def in_known_language(
    docs: DataFrame, known: dict[str, np.ndarray], min_score: float = MIN_SCORE, text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text has a language: letters, and a prototype at a cosine of ``min_score`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _nearest(known, DIMENSIONS, SEED)
        for batch, texts in slices(batches, text):
            names, score = nearest(texts)
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Prediction of every document with profiles of the labelled documents that are not held out."""
    known = profiles(docs.where(~is_held_out()))
    found = predict(docs, known)
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def op1_language_id(spark, root: str) -> DataFrame:
    """Predicted language of every document."""
    return identified(spark.read.parquet(f"{root}/documents.parquet"))
