"""Content-chosen anchors for repeated-window search, vectorised with numpy.

Two operators look for windows (runs of W items) that occur more than once in
the whole corpus: W = 20 words for substring dedup, W = 200 bytes for
suffix-array dedup.  Shipping one key per window would multiply the corpus, so
each window is represented by its *anchor*: the smallest hashed k-gram inside
it (leftmost on ties).  Equal windows always pick the same anchor at the same
offset, hence a repeated window always has a repeated anchor, and consecutive
windows mostly share one.  A maximal run of windows with one anchor is a
*segment*; the items it spans are its *hull*.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
#: Low bits of a window key that hold the position; bounds the items of one chunk.
_POS_BITS = U64(26)
_POS_MASK = U64((1 << 26) - 1)
MAX_ITEMS = (1 << 26) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads the entropy of every bit over the whole word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two spans that follow each other; not linear, so exchanged or mirrored halves differ."""
    x = a >> U64(29)
    x ^= a
    x *= U64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> U64(32)
    return x


class SpanHash:
    """Hashes of spans of items: those of 2, 4, 8, ... items are joined from halves.

    A span of any length is told by its first and its last power of two of items
    (which overlap) and its length.  Nothing is a polynomial, so regular texts
    (periods, Thue-Morse words) do not meet.
    """

    def __init__(self, items: np.ndarray) -> None:
        self.n = len(items)
        self.levels = {1: mix(items.astype(U64) + U64(0x632BE59BD9B4E019))}

    def level(self, size: int) -> np.ndarray:
        """Hash of the ``size`` items (a power of two) from every place."""
        if size not in self.levels:
            half = self.level(size // 2)
            self.levels[size] = _join(half[: -(size // 2)], half[size // 2 :]) if self.n >= size else np.zeros(0, U64)
        return self.levels[size]

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k items in a row."""
        if self.n < k:
            return np.zeros(0, U64)
        size = 1 << (k.bit_length() - 1)
        part = self.level(size)
        return mix(_join(part[: self.n - k + 1], part[k - size :]) + U64(k))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of items[start:end] for every pair; empty spans are 0."""
        out = np.zeros(len(start), U64)
        length = end - start
        size = np.int64(1) << np.floor(np.log2(np.maximum(length, 1) + 0.5)).astype(np.int64)
        for s in np.unique(size[length > 0]).tolist():
            mine = np.flatnonzero((size == s) & (length > 0))
            part = self.level(s)
            out[mine] = mix(_join(part[start[mine]], part[end[mine] - s]) + length[mine].astype(U64))
        return out


@dataclass
class Segments:
    """One row per segment: anchor position, its k-gram hash, window range, hull hashes."""

    anchor: np.ndarray  # item index of the anchor's first item
    key: np.ndarray  # uint64 hash of the anchor's k-gram
    first: np.ndarray  # item index of the first window's start
    last: np.ndarray  # item index of the last window's start
    hull: np.ndarray  # uint64 hash of items[first : last + window], anchor offset mixed in


def segments(items: np.ndarray, bounds: np.ndarray, window: int, k: int) -> Segments:
    """Segments of all windows inside the documents that ``bounds`` delimits.

    items: one integer per item (byte value or word hash), documents back to back.
    bounds: document starts, ending with len(items).
    """
    n = len(items)
    empty = np.zeros(0, dtype=np.int64)
    if n < window:
        return Segments(empty, empty.astype(U64), empty, empty, empty.astype(U64))
    if n > MAX_ITEMS:
        raise ValueError("chunk too large: split it with an overlap of window - 1 items")
    hashes = SpanHash(items)
    grams = hashes.grams(k)
    low = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=U64)
    span, have = window - k + 1, 1
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    inside = np.zeros(n + 1, dtype=np.int32)  # windows that cross a document's end
    lengths = np.diff(bounds)
    starts, ends = bounds[:-1], np.maximum(bounds[1:] - window + 1, bounds[:-1])
    some = lengths >= window
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1])[: len(low)] > 0)
    if not len(at):
        return Segments(empty, empty.astype(U64), empty, empty, empty.astype(U64))
    where = (low[at] & _POS_MASK).astype(np.int64)
    cut = np.flatnonzero((np.diff(where) != 0) | (np.diff(at) != 1)) + 1
    head = np.concatenate(([0], cut))
    tail = np.concatenate((cut, [len(at)])) - 1
    anchor, first, last = where[head], at[head], at[tail]
    hull = mix(hashes.spans(first, last + window) ^ mix((anchor - first).astype(U64) + U64(0x51ED2701)))
    return Segments(anchor, grams[anchor], first, last, hull)
