"""Words of whole texts as numbers, for a chunk of documents at once.

A word is a run of bytes other than the six ASCII white-space characters, which
is ``[^\\x20\\x09-\\x0D]+`` on the text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_in(texts: list[str], lower: bool = False) -> list[list[bytes]]:
    return [(encoded(t).lower() if lower else encoded(t)).split() for t in texts]


class Coded:
    """Distinct words, the word number at each place, and the number of words of each document; ``lists`` are the texts' words, if known."""

    def __init__(self, texts: list[str], lower: bool = False, lists: list[list[bytes]] | None = None):
        lists = words_in(texts, lower) if lists is None else lists
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(self.counts.sum())
        self.codes = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int32, total)
        self.words = list(index)
        self.doc = np.repeat(np.arange(len(lists), dtype=np.int32), self.counts)
        self.docs = len(lists)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _PRIME) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Spelled:
    """The distinct words as one byte string, each between ``<`` and ``>``, for hashes of words and character n-grams."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.bytes = np.frombuffer(b"<" + b"><".join(words) + b">" if words else b"", np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.word = np.repeat(np.arange(self.n, dtype=np.int32), self.lengths)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not self.n:
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.bytes)) - np.repeat(self.starts, self.lengths)
        terms = (self.bytes.astype(np.uint64) + _STEP) * powers(int(self.lengths.max()))[place]
        return mixed(np.add.reduceat(terms, self.starts) + self.lengths.astype(np.uint64) * _STEP)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, 64-bit hash) of each n-gram of bytes inside a word's marks."""
        size = len(self.bytes) - n + 1
        if size <= 0:
            return np.zeros(0, np.int32), np.zeros(0, np.uint64)
        h = np.zeros(size, np.uint64)
        for k, p in enumerate(powers(n)):
            h += self.bytes[k:k + size].astype(np.uint64) * p
        inside = np.arange(size) + n <= self.ends[self.word[:size]]
        return self.word[:size][inside], mixed(h[inside] * _STEP + np.uint64(n))
