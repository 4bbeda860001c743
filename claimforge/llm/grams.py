"""Hashes of token ranges and minimizer anchors, in numpy over whole buffers.

A window of W units (bytes or words) always holds the anchor that its content selects: the leftmost of the k-grams with
the least hash. Equal windows have the same anchor at the same place, so only windows around shared anchors can repeat.
The block of an anchor is everything that a window with this anchor can reach: W - k units to its left, W from its start.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SLICE = 1 << 19  # units hashed at a time; bounds the memory of a worker
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _POW or len(_POW["r"]) < n:
        size = max(n, SLICE + 4096)
        r, inverse = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
        for name, base in (("r", r), ("inv", inverse)):
            x = np.full(size, U(base))
            x[0] = 1
            _POW[name] = np.multiply.accumulate(x)
    return _POW["r"], _POW["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each input bit reaches each output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


class Ranges:
    """Hash of any range of units in constant time: prefix sums of a polynomial, shifted to the origin."""

    def __init__(self, units: np.ndarray):
        r, self.inv = _powers(len(units) + 1)
        self.p = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * r[: len(units)], out=self.p[1:])

    def of(self, a, b) -> np.ndarray:
        return (self.p[b] - self.p[a]) * self.inv[a]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.p) - k
        return (self.p[k:] - self.p[:n]) * self.inv[:n] if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, step = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * step <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[w - step : w - step + n]) if step < w else x[:n]


def _pieces(bounds: np.ndarray, window: int):
    """(a, b, first, last, lo, hi): slices [a, b) over documents first..last whose windows start in [lo, hi)."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1
        if j > i:
            yield int(bounds[i]), int(bounds[j]), i, j, int(bounds[i]), int(bounds[j])
            i = j
            continue
        start, end = int(bounds[i]), int(bounds[i + 1])
        for lo in range(start, end, SLICE):
            hi = min(lo + SLICE, end)
            yield max(start, lo - 2 * window), min(end, hi + 2 * window), i, i + 1, lo, hi
        i += 1


def anchors(units_of, bounds: np.ndarray, window: int, k: int):
    """Anchors of all documents: arrays (document, place in it, hash of the anchor, hash of its block).

    units_of(a, b) gives the hashes of units a..b; bounds are the documents' first units and the end of the last.
    """
    w, bits = window - k + 1, U(22)
    mask = (U(1) << bits) - U(1)
    found: list[list[np.ndarray]] = [[], [], [], []]
    for a, b, i, j, lo, hi in _pieces(bounds, window):
        if b - a < window:
            continue
        ranges = Ranges(units_of(a, b))
        gram = mix(ranges.grams(k))
        key = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
        place = (sliding_min(key, w) & mask).astype(np.int64)
        starts, ends = np.maximum(bounds[i:j], a) - a, np.minimum(bounds[i + 1 : j + 1], b) - a
        s = np.arange(len(place))
        doc = np.searchsorted(ends, s, "right")
        ok = (s + a >= lo) & (s + a < hi)
        ok &= s + window <= ends[np.minimum(doc, len(ends) - 1)]
        place, doc = place[ok], doc[ok]
        if not len(place):
            continue
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        place, doc = place[new], doc[new]
        left, right = np.maximum(place - (window - k), starts[doc]), np.minimum(place + window, ends[doc])
        block = mix(ranges.of(left, right) + (place - left).astype(np.uint64) * U(0xD6E8FEB86659FD93) + (right - place).astype(np.uint64) * U(0xA0761D6478BD642F))
        base = bounds[i:j][doc]
        for out, x in zip(found, (doc + i, place + a - base, mix(gram[place] + U(77)), block), strict=True):
            out.append(x)
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, place, anchor, block = map(np.concatenate, found)
    # a long document's slices may meet in the same anchor
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    return doc[keep], place[keep], anchor[keep].view(np.int64), block[keep].view(np.int64)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of all texts, and the number of the first word of each text; space: the bytes that words don't have."""
    a, b = int(off[0]), int(off[-1])
    solid = ~space[raw[a:b]]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = np.flatnonzero(np.diff(off))
    first, last = off[full] - a, off[full + 1] - a - 1
    start[first] = solid[first]
    end[last] = solid[last]
    s, e = np.flatnonzero(start) + a, np.flatnonzero(end) + a + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, hashed in slices of bytes."""
    out, i = np.zeros(len(s), np.uint64), 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE, "right")))
        a, b = int(s[i]), int(e[j - 1])
        out[i:j] = mix(Ranges(BYTE[raw[a:b]]).of(s[i:j] - a, e[i:j] - a) + (e[i:j] - s[i:j]).astype(np.uint64))
        i = j
    return out
