"""Content-defined anchors of byte strings, for a chunk of texts at once.

Every string of ``length`` bytes is named by one of its ``GRAM``-byte grams: the one with the least fingerprint, the
last of equals.  The choice depends on the string's bytes only, so equal strings have their
anchor at the same place wherever they occur: the anchors are a difference cover for
equal strings.  Strings that start one after the other mostly share their anchor.
"""

from __future__ import annotations

import numpy as np

from .words import mixed

GRAM = 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 32) - 1)  # places in a chunk fit into so many bits
_BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of any parts of one buffer, alike for equal bytes in any buffer."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw))[:len(raw)], dtype=np.uint64, out=self.sums[1:])
        self.back = _powers(_INVERSE, len(raw))

    def parts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _fingerprints(raw: np.ndarray) -> np.ndarray:
    h, power, size = _BYTES[raw], _BASE, 1
    while size < GRAM:
        h = h[:len(h) - size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), 2 * size
    return mixed(h)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v, size = np.minimum(v[:len(v) - size], v[size:]), 2 * size
    return np.minimum(v[:len(v) - (width - size)], v[width - size:]) if size < width else v


class Anchors:
    """``at``: places of the anchors in the chunk; ``first`` .. ``last``: the starts of the strings they name; ``doc``; ``print``."""

    def __init__(self, parts: list[bytes], length: int):
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        width = length - GRAM + 1
        usable = np.flatnonzero(self.sizes >= length)
        if not len(usable):
            self.at = self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.print = np.zeros(0, np.uint64)
            return
        f = _fingerprints(self.raw)
        keyed = (f & ~_PLACE) | (_PLACE - np.arange(len(f), dtype=np.uint64))
        chosen = (_PLACE - (_sliding_min(keyed, width) & _PLACE)).astype(np.int64)
        counts = self.sizes[usable] - length + 1
        doc = np.repeat(usable, counts)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.starts[usable], counts)
        chosen = chosen[start]
        new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))
        self.at, self.doc, self.first = chosen[new], doc[new], start[new]
        self.last = start[np.append(new[1:], len(start)) - 1]
        self.print = f[self.at]
