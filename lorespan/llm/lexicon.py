"""BPE encoding and decoding through a lexicon of frequent words: a minimal acyclic transducer, mapped into memory by tasks."""

from __future__ import annotations

import functools
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import arrow_step, slices
from lorespan.llm.tokens import tokenizer_path
from lorespan.session import scratch_path

#: Words of the lexicon, the most frequent of the corpus. The bound is that of the driver's work; ids never depend on it.
LEXICON_WORDS = 131_072
#: Bytes of the longest word that the lexicon takes.
LONGEST = 48
#: Distinct pieces that a counting task holds before it hands its counts on.
COUNTED = 200_000
#: Pieces of text whose ids a worker remembers, and their characters in all, before it forgets them.
REMEMBER, REMEMBER_CHARS = 150_000, 1 << 24

# The byte-level scheme's pre-token pattern.
PRETOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Up to U+02FF the pattern's classes are those of the tokenizers library; texts with other characters are cut by the library.
_OTHER = re.compile("[^\0-˿]")
#: Those characters and all white space but space and line feed.
_STRANGE = re.compile("[^\0-\x08\n\x0e-\x1b\x20-\x84\x86-\x9f\xa1-˿]")


def _even(text: str) -> bool:
    """Whether every white space is one space or line feed between other characters, and no character is strange."""
    ends = text[0] in " \n" or text[-1] in " \n"
    return not (ends or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _STRANGE.search(text))


MAGIC = b"LXT1"
_PARTS = ("key", "target", "out_at", "out_n", "last_at", "last_n", "pool")


class _State:
    """A state in the making: its arcs (byte to target and ids), whether a word ends here, and the ids given then."""

    __slots__ = ("arcs", "end", "last", "number")

    def __init__(self):
        self.arcs, self.end, self.last, self.number = {}, False, (), -1

    def form(self) -> tuple:
        return self.end, self.last, tuple((c, id(s), out) for c, (s, out) in self.arcs.items())


def _shared(x: tuple, y: tuple) -> int:
    n = 0
    for a, b in zip(x, y):
        if a != b:
            break
        n += 1
    return n


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal acyclic transducer of ``entries`` (distinct words in ascending order, each with its ids) as a file's bytes.

    Words are added in order. Ids stand on the earliest arc at which they are certain: where a new word shares a
    prefix, ids that it does not share are pushed behind the prefix. What no later word can change is replaced by an
    equal state if there is one (same arcs, targets and ids), so suffixes are shared. The file holds arrays alone: arcs
    sorted by ``256 * state + byte``, with their target and place in a pool of ids, and per state the ids at its end.
    """
    known: dict[tuple, _State] = {}
    path = [_State()]
    word = b""

    def settle(depth: int) -> None:
        for k in range(len(word), depth, -1):
            state = path.pop()
            same = known.setdefault(state.form(), state)
            arc = path[-1].arcs[word[k - 1]]
            path[-1].arcs[word[k - 1]] = (same, arc[1])

    for new, ids in entries:
        if new <= word and (word or path[0].end):
            raise ValueError("words must be distinct and ascending")
        common = _shared(word, new)
        settle(common)
        left = tuple(ids)
        for k in range(common):
            state, out = path[k].arcs[new[k]]
            n = _shared(out, left)
            if n < len(out):
                rest = out[n:]
                state.arcs = {c: (s, rest + o) for c, (s, o) in state.arcs.items()}
                state.last = rest + state.last if state.end else ()
                path[k].arcs[new[k]] = (state, out[:n])
            left = left[n:]
        for k in range(common, len(new)):
            path.append(_State())
            path[k].arcs[new[k]] = (path[-1], left if k == common else ())
        path[-1].end = True
        if common == len(new):
            path[-1].last = left
        word = new
    settle(0)
    return _laid_out(path[0])


def _laid_out(root: _State) -> bytes:
    states, wait = [], [root]
    root.number = 0
    while wait:
        state = wait.pop()
        states.append(state)
        for target, _ in state.arcs.values():
            if target.number < 0:
                target.number = len(states) + len(wait)
                wait.append(target)
    for n, state in enumerate(states):
        state.number = n
    pool, places = [], {(): 0}

    def place(ids: tuple) -> int:
        if ids not in places:
            places[ids] = len(pool)
            pool.extend(ids)
        return places[ids]

    arcs = [
        (256 * state.number + byte, target.number, place(out), len(out))
        for state in states
        for byte, (target, out) in sorted(state.arcs.items())
    ]
    ends = [(place(s.last), len(s.last)) if s.end else (0, -1) for s in states]
    columns = [np.array(c, "<i8") for c in zip(*arcs)] or [np.zeros(0, "<i8")] * 4
    columns += [np.array(c, "<i8") for c in zip(*ends)]
    columns.append(np.array(pool, "<i8"))
    head = np.array([len(c) for c in columns], "<i8")
    return MAGIC.ljust(8, b"\0") + head.tobytes() + b"".join(c.tobytes() for c in columns)


class Transducer:
    """A compiled lexicon in a file that is mapped into memory: workers of a machine share its pages."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="<i8", mode="r")
        if raw[:1].tobytes()[: len(MAGIC)] != MAGIC:
            raise ValueError("not a lexicon")
        at = 1 + len(_PARTS)
        for name, n in zip(_PARTS, raw[1:at].tolist()):
            setattr(self, name, raw[at : at + n])
            at += n

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are in the lexicon, how many ids each has (0 if not in it), and all ids in the order of the words.

        All words take their next arc at once, so there are as many steps as the longest word has bytes.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        longest = int(sizes.max(initial=0))
        letters = np.zeros((len(words), longest), np.uint8)
        letters[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        state = np.zeros(len(words), np.int64)
        runs_at = np.zeros((len(words), longest + 1), np.int64)
        runs_n = np.zeros((len(words), longest + 1), np.int64)
        live = np.arange(len(words))
        for k in range(longest):
            live = live[(sizes[live] > k) & (state[live] >= 0)]
            if not len(live):
                break
            wanted = 256 * state[live] + letters[live, k]
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1) if len(self.key) else np.zeros(len(live), np.int64)
            hit = self.key[arc] == wanted if len(self.key) else np.zeros(len(live), bool)
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            state[live] = self.target[arc]
            runs_at[live, k], runs_n[live, k] = self.out_at[arc], self.out_n[arc]
        found = state >= 0
        found[found] = self.last_n[state[found]] >= 0
        at_end = state[found]
        runs_at[found, -1], runs_n[found, -1] = self.last_at[at_end], self.last_n[at_end]
        runs_n[~found] = 0
        return found, runs_n.sum(axis=1), _gather(self.pool, runs_at.ravel(), runs_n.ravel())


def _gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ``pool[at : at + n]`` one after another."""
    some = n > 0
    at, n = at[some], n[some]
    before = np.cumsum(n) - n
    return pool[np.repeat(at - before, n) + np.arange(int(n.sum()))]


class Codec:
    """The tokenizers library's vocabulary, the way it cuts texts, its merges, and the bytes of its tokens."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.model = self.lib.model
        added = self.lib.get_added_tokens_decoder()
        self.special = {t.content: n for n, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in stays]
        self.letters = {b: chr(b) for b in stays} | {b: chr(256 + n) for n, b in enumerate(moved)}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        return PRETOKEN.findall(text)

    def pieces(self, text: str | None) -> list:
        """A text in pieces that no pre-token reaches across; :meth:`words_of` gives their pre-tokens.

        Where white space is single, a space begins a pre-token and a line feed is one, so the text falls apart there
        without a look at its letters. The first such piece is marked by a carriage return, which it cannot hold; a
        tab marks a pre-token of any other text, and a special token is a tuple of its id.
        """
        if not text:
            return []
        out: list = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append((self.special[part],))
            elif part and _even(part):
                out += ("\r" + part.replace("\n", " \n")).split(" ")
            elif part:
                out += ["\t" + w for w in self.words(part)]
        return out

    def words_of(self, piece: str) -> list[str]:
        if piece[0] == "\t":
            return [piece[1:]]
        return PRETOKEN.findall(piece[1:] if piece[0] == "\r" else piece if piece[0] == "\n" else " " + piece)

    def merged(self, word: str) -> list[int]:
        """The ids of one pre-token by the merge rules."""
        if word.isascii() and word.isprintable():
            written = word.replace(" ", self.letters[32])
        else:
            written = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(written)]

    @functools.cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each id's bytes, and the bytes. Ids without a token have none."""
        back = {c: b for b, c in self.letters.items()}
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        found = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, n in vocabulary.items():
            found[n] = bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
        n = np.array([len(b) for b in found], np.int64)
        return np.cumsum(n) - n, n, np.frombuffer(b"".join(found), np.uint8)


@functools.cache
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def frequent_words(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS, text: str = "text") -> DataFrame:
    """``word, n`` of the ``size`` most frequent pre-tokens of all texts (ties: the smaller word), of at most ``LONGEST`` bytes.

    Tasks add up before they hand counts on, and the counts of a word meet as partial sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = codec(vocabulary), Counter()

        def given() -> pa.RecordBatch:
            words = Counter()
            for piece, n in counts.items():
                for w in own.words_of(piece) if isinstance(piece, str) else ():
                    words[w] += n
            held = [(w, n) for w, n in words.items() if len(w.encode()) <= LONGEST]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["word", "n"])

        for _, texts in slices(batches, "t"):
            for t in texts:
                counts.update(own.pieces(t))
            if len(counts) >= COUNTED:
                yield given()
        if counts:
            yield given()

    found = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compile the frequent words of ``docs`` and give the file to every executor, also to later ones; returns its name.

    The driver holds ``size`` short words at most. The file lies in the shared folder; an executor fetches it once.
    """
    own = codec(vocabulary)
    words = sorted(r.word.encode() for r in frequent_words(docs, vocabulary, size, text).toLocalIterator())
    data = compile_lexicon((w, tuple(own.merged(w.decode()))) for w in words)
    spark = docs.sparkSession
    path = f"{scratch_path(spark, 'lexicon')}.lxt"
    spark.sparkContext.addFile(_put(spark, path, data))
    return os.path.basename(path)


def _put(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a file through Spark's file systems; returns its whole address."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(place)
    out.write(bytearray(data))
    out.close()
    return files.makeQualified(place).toString()


class Memory:
    """Ids of the pieces that a worker has seen: each new piece is read off the transducer or merged once."""

    def __init__(self, own: Codec, lexicon: Transducer):
        self.own, self.lexicon = own, lexicon
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict = defaultdict()
        self.index.default_factory = self.index.__len__
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = 0

    def learn(self) -> None:
        """Find the ids of the pieces that have come to the index since the last call."""
        new = list(islice(self.index, len(self.sizes), None))
        lists = [self.own.words_of(p) if isinstance(p, str) else [p] for p in new]
        self.chars += sum(map(len, new))
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        codes = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64)
        words = list(index)
        plain = [k for k, w in enumerate(words) if isinstance(w, str) and len(w) <= LONGEST]
        found, n, ids = self.lexicon.look_up([words[k].encode() for k in plain])
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = n
        starts = np.cumsum(sizes) - sizes
        unseen = np.ones(len(words), bool)
        unseen[np.array(plain, np.int64)[found]] = False
        unseen = np.flatnonzero(unseen)
        merged = [self.own.merged(words[k]) if isinstance(words[k], str) else words[k] for k in unseen.tolist()]
        sizes[unseen] = [len(m) for m in merged]
        starts[unseen] = len(ids) + np.cumsum(sizes[unseen]) - sizes[unseen]
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(merged), np.int64)])
        until = np.concatenate([[0], np.cumsum(sizes[codes])])
        ends = until[np.cumsum([0, *map(len, lists)])]
        self.starts = np.concatenate([self.starts, ends[:-1] + len(self.pool)])
        self.sizes = np.concatenate([self.sizes, np.diff(ends)])
        self.pool = np.concatenate([self.pool, _gather(ids, starts[codes], sizes[codes])])

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every text, and all ids."""
        if len(self.index) >= REMEMBER or self.chars >= REMEMBER_CHARS:
            self.forget()
        codes, ends, find = [], [0], self.index.__getitem__
        for t in texts:
            codes += map(find, self.own.pieces(t))
            ends.append(len(codes))
        self.learn()
        codes = np.array(codes, np.int64)
        until = np.concatenate([[0], np.cumsum(self.sizes[codes])])
        return np.diff(until[np.array(ends)]), _gather(self.pool, self.starts[codes], self.sizes[codes])


@functools.cache
def memory(vocabulary: str, lexicon: str) -> Memory:
    return Memory(codec(vocabulary), Transducer(SparkFiles.get(lexicon)))


def encode(docs: DataFrame, vocabulary: str, lexicon: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with ``name``, the ids of every whole text as the tokenizers library gives them, in place of ``text``.

    Words of the lexicon (the file of :func:`build_lexicon`) are read off the transducer; others go through the merge
    rules, so the lexicon never changes an id. Special tokens inside a text are the library's. A null or empty text has
    no ids; a text of any length is cut into words and never shortened. Other columns pass as they are, whatever their
    names; a column called ``name`` is replaced.
    """
    others = [c for c in docs.columns if c not in (text, name)]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.col(text).alias("t"))
    kinds = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(others))

    def step(batch: pa.RecordBatch, texts: list) -> list:
        n, ids = memory(vocabulary, lexicon).encoded(texts)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        return [*(batch.column(k) for k in range(len(others))), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))]

    found = arrow_step(rows, "t", f"{kinds}{', ' if others else ''}ids array<int>", step)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(others)], F.col("ids").alias(name))


def decoded(lists: list[np.ndarray | None], own: Codec) -> list[str | None]:
    """The texts of lists of ids; special tokens stay, ids without a token give nothing, bytes that are no UTF-8 U+FFFD."""
    start, size, pool = own.token_bytes
    out = []
    for ids in lists:
        if ids is not None:
            ids = np.asarray(ids, np.int64)
            ids = ids[(ids >= 0) & (ids < len(start))]
        out.append(None if ids is None else _gather(pool, start[ids], size[ids]).tobytes().decode("utf-8", "replace"))
    return out


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with one more column ``name``, the text of the ids as the library decodes them, special tokens included.

    Null ids give a null, an empty list an empty text. A column called ``name`` is replaced.
    """
    kept = rows.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rows.columns)])
    at = rows.columns.index(ids)
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(rows.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                column = part.column(at)
                # A list with null members cannot come from the encoder; such members count as ids without a token.
                values = [v.values.fill_null(-1).to_numpy(zero_copy_only=False) if v.is_valid else None for v in column]
                texts = pa.array(decoded(values, own), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "t"])

    found = kept.mapInArrow(run, f"{kinds}, t string")
    others = [F.col(f"c{k}").alias(c) for k, c in enumerate(rows.columns) if c != name]
    return found.select(*others, F.col("t").alias(name))


def op13_bpe_transducer(spark, root: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Number and digest of the ids of every document, and the digest of what they decode to."""
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs, vocabulary, build_lexicon(docs, vocabulary)), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
