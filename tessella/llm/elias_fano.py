"""An n-gram trie in Elias-Fano levels: flat arrays that can be written to files and memory-mapped.

Every query works on arrays of keys at once.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

_ONE = np.uint64(1)
_STEP = 1 << 16


@dataclass
class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values: low bits packed, high parts in unary."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        top = (values >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        bits = np.zeros((n + (int(top[-1]) if n else 0) + 1 + 63) // 64 * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        packed = []
        places = np.arange(width, dtype=np.uint64)
        for s in range(0, n, _STEP):  # a multiple of 64 values ends on a whole word
            part = ((values[s : s + _STEP, None] >> places) & _ONE).astype(np.uint8).ravel()
            part = np.concatenate([part, np.zeros(-len(part) % 64, np.uint8)])
            packed.append(np.packbits(part, bitorder="little").view("<u8"))
        low = np.concatenate([*packed, np.zeros(1, "<u8")]) if packed else np.zeros(1, "<u8")
        ones = np.concatenate([np.zeros(1, "<u4"), np.cumsum(np.bitwise_count(high), dtype="<u4")])
        return cls(n, width, low, high, ones)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.width
        word, off = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> off
        more = np.where(off > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << (np.uint64(64) - np.maximum(off, _ONE)), np.uint64(0))
        return (first | more) & np.uint64((1 << self.width) - 1)

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) set bit of each word, by halving."""
        place, k = np.zeros(len(word), np.int64), k.astype(np.int64).copy()
        for half in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count((word >> place.astype(np.uint64)) & ((_ONE << np.uint64(half)) - _ONE)).astype(np.int64)
            past = k >= lower
            k -= np.where(past, lower, 0)
            place += np.where(past, half, 0)
        return place

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = (word << 6) + self._in_word(self.high[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def _before(self, top: np.ndarray) -> np.ndarray:
        """How many values have a high part below top."""
        zeros = (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones
        k = top - 1  # the values stand before the zero that ends the part before
        known = (top > 0) & (k < zeros[-1])
        k = np.where(known, k, 0)
        word = np.minimum(np.searchsorted(zeros, k, side="right") - 1, len(self.high) - 1)
        at = (word << 6) + self._in_word(~self.high[word], k - zeros[word])
        return np.where(known, at - k, np.where(top > 0, self.n, 0))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below x (n if there is none)."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        top = np.minimum(x >> np.uint64(self.width), np.uint64(1 << 62)).astype(np.int64)
        at, end = self._before(top), self._before(top + 1)
        want = x & np.uint64((1 << self.width) - 1)
        live = np.flatnonzero(at < end)
        lo, hi, want = at[live], end[live], want[live]
        while len(live):  # halving among the values of one high part
            mid = (lo + hi) >> 1
            below = self._lows(mid) < want
            lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
            at[live] = lo
            more = lo < hi
            live, lo, hi, want = live[more], lo[more], hi[more], want[more]
        return at

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of a value equal to x, or -1."""
        at = self.successor(x)
        inside = np.flatnonzero(at < self.n)
        equal = np.zeros(len(at), bool)
        equal[inside] = self.access(at[inside]) == np.asarray(x, np.uint64)[inside]
        return np.where(equal, at, -1)

    def parts(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.width], "<i8"), "low": self.low, "high": self.high, "ones": self.ones}

    @classmethod
    def from_parts(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(parts["head"][0]), int(parts["head"][1]), parts["low"], parts["high"], parts["ones"])


class Trie:
    """Contexts, their pointers, and their successors with quantised log10 probabilities.

    contexts: sorted keys of the words that have successors. pointers: where each one's successors
    begin, so it never falls. vocabulary: sorted keys of all successors; a successor is held by its
    rank there, relative to its context: the ranks of a context start after the last one of the
    context before, so that the whole level rises and one successor search finds a child.
    """

    LEVELS = ("contexts", "pointers", "vocabulary", "successors")

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray, book: np.ndarray):
        self.levels, self.codes, self.book = levels, codes, book

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log_p: np.ndarray) -> Trie:
        """From distinct pairs sorted by (context, word)."""
        contexts, first = np.unique(context, return_index=True)
        vocabulary, rank = np.unique(word, return_inverse=True)
        rank = rank.astype(np.int64)
        ends = np.append(first[1:], len(word)) - 1
        base = np.concatenate([[0], np.cumsum(rank[ends] + 1)[:-1]]) if len(first) else np.zeros(0, np.int64)
        shifted = rank + np.repeat(base, np.diff(np.append(first, len(word)))) if len(first) else rank
        codes, book = quantise(log_p)
        made = (contexts, np.append(first, len(word)), vocabulary, shifted)
        return cls({k: EliasFano.of(v) for k, v in zip(cls.LEVELS, made, strict=True)}, codes, book)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each pair; 0 where the trie doesn't hold it."""
        out = np.zeros(len(context), np.uint8)
        if not self.levels["contexts"].n or not len(context):
            return out
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))  # pairs stand in runs by context
        some, back = context[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        at = self.levels["contexts"].find(some)
        known = np.maximum(at, 0)
        begin, end = (self.levels["pointers"].access(known + k).astype(np.int64) for k in (0, 1))
        base = np.where(begin > 0, self.levels["successors"].access(np.maximum(begin - 1, 0)).astype(np.int64) + 1, 0)
        words, wback = np.unique(word, return_inverse=True)
        rank = self.levels["vocabulary"].find(words)[wback]
        ask = np.flatnonzero((at[back] >= 0) & (rank >= 0))
        want = base[back[ask]] + rank[ask]
        place = self.levels["successors"].find(want)
        hit = (place >= begin[back[ask]]) & (place < end[back[ask]])
        out[ask[hit]] = self.codes[place[hit]]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {f"{k}.{p}": a for k, e in self.levels.items() for p, a in e.parts().items()} | {"codes": self.codes, "book": self.book}

    @classmethod
    def from_arrays(cls, arrays: dict[str, np.ndarray]) -> Trie:
        levels = {k: EliasFano.from_parts({p: arrays[f"{k}.{p}"] for p in ("head", "low", "high", "ones")}) for k in cls.LEVELS}
        return cls(levels, arrays["codes"], arrays["book"])

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for name, a in self.arrays().items():
            np.save(f"{folder}/{name}.npy", a)

    @classmethod
    def open(cls, folder: str) -> Trie:
        """With its levels memory-mapped."""
        return cls.from_arrays({f[:-4]: np.load(f"{folder}/{f}", mmap_mode="r") for f in sorted(os.listdir(folder)) if f.endswith(".npy")})


def quantise(log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes from 1, value of each code): bins of equal width, each held by the mean of its values; 0 means absent."""
    values, back, many = np.unique(log_p, return_inverse=True, return_counts=True)
    if len(values) <= 255:
        bins = np.arange(len(values))
    else:
        bins = np.minimum(254, ((values - values[0]) * (255 / (values[-1] - values[0]))).astype(np.int64))
    total, weight = np.bincount(bins, values * many, 255), np.bincount(bins, many, 255)
    book = np.concatenate([[0.0], np.where(weight > 0, total / np.maximum(weight, 1), 0.0)])
    return (bins[back] + 1).astype(np.uint8), book
