"""Token ids of whole texts, as the ``tokenizers`` library gives them, at a multiple of its speed.

A text is cut where no pre-token can reach across, and ids of the cut pieces are remembered in the worker. What the
library does not see as such a piece, because the memory knows it, was given by the library before. Texts that name a
special token go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable

from lorespan.llm.common import remembers

#: Pieces that a worker remembers before it forgets all, and the longest piece that it remembers.
REMEMBER = 1_000_000
LONGEST = 40

_ENDS = ".,"
_SAFE_SPACE = re.compile(r"(?<=[A-Za-z0-9.,;:!?]) (?=[A-Za-z0-9])")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(word: str) -> bool:
    """Letters of Latin-1 alone: one pre-token in every scheme, lower-cased letter by letter."""
    return word.isalpha() and max(word) < "Ā"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level schemes write bytes as: printable Latin-1 stays, the others follow from 256 on."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in stays]
    return {b: chr(b) for b in stays} | {b: chr(256 + n) for n, b in enumerate(moved)}


_LETTERS = _byte_letters()


def evenly_spaced(text: str) -> bool:
    """Whether every white space is one space or one line feed between other characters."""
    words = text.split()
    gaps = len(words) - 1
    return text.count(" ") + text.count("\n") == gaps and sum(map(len, words)) + gaps == len(text)


class _Memory(dict):
    def __init__(self, find: Callable):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str):
        found = self.find(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBER:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """A tokenizer with its memory. ``of`` turns a list of ids into what is remembered and joined."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_path(name))
        added = self.lib.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.keeps_space = self.lib.normalizer is None
        self.model = self.lib.model
        self.known = _Memory(self._whole)
        self.words = _Memory(self._word)
        self.first = _Memory(self._bare)
        self.spaced = _Memory(self._after_space)

    def _whole(self, piece: str) -> bytes:
        return array("I", self.lib.encode(piece, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def as_letters(word: str) -> str:
        return word.encode().decode("latin-1").translate(_LETTERS)

    def _word(self, word: str) -> bytes:
        """A single pre-token, straight from the library's model."""
        return array("I", [t.id for t in self.model.tokenize(self.as_letters(word))]).tobytes()

    def _split(self, piece: str, lead: str) -> bytes:
        """A piece without white space inside (but for single line feeds), after a space if ``lead`` is one."""
        if "\n" in piece:
            head, *rest = piece.split("\n")
            feed = self.known["\n"] if self.keeps_space else b""
            return (self.spaced if lead else self.first)[head] + b"".join(feed + self.first[r] for r in rest)
        if len(piece) > 1 and piece[-1] in _ENDS and _plain(piece[:-1]):
            return (self.spaced if lead else self.first)[piece[:-1]] + self.known[piece[-1]]
        if piece and _plain(piece):
            return self._word(lead + piece) if self.keeps_space else self.words[piece.lower()]
        return self.known[lead + piece] if piece or lead else b""

    def _bare(self, piece: str) -> bytes:
        return self._split(piece, "")

    def _after_space(self, piece: str) -> bytes:
        return self._split(piece, " ")

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        if not self.keeps_space:
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        head, *rest = text.split(" ")
        if evenly_spaced(text):
            return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))
        head, *rest = _SAFE_SPACE.split(text)
        return self.known[head] + b"".join([self.known[" " + r] for r in rest])


_encoders = functools.cache(Encoder)


def encoder(name: str) -> Encoder:
    """One encoder per worker process and vocabulary file, as long as it serves this kind of step."""
    remembers("tokens", _encoders.cache_clear)
    return _encoders(name)
