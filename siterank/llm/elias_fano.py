"""Elias-Fano coding of monotone sequences, searched in numpy arrays or memory maps."""

from __future__ import annotations

import numpy as np


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit number ``rank`` (from 0) of each 64-bit word."""
    at, words, rank = np.zeros(len(words), np.int64), words.copy(), rank.copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        up = rank >= low
        rank -= np.where(up, low, 0)
        at += np.where(up, half, 0)
        words = np.where(up, words >> np.uint64(half), words)
    return at


class EliasFano:
    """A non-decreasing sequence of unsigned integers below ``2 ** 63``.

    The low bits of an element are whole bytes, as many as the mean gap asks for; its high bits are coded in unary.
    ``parts`` are its arrays, which may be memory maps.
    """

    def __init__(self, length: int, low_bytes: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.length, self.low_bytes, self.low, self.high, self.ones = length, low_bytes, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        gap = int(values[-1]) // n if n else 0
        low_bytes = -(-max(gap, 1).bit_length() // 8) if gap > 1 else 0
        low = np.ascontiguousarray(values.view(np.uint8).reshape(n, 8)[:, :low_bytes])
        high = (values >> np.uint64(8 * low_bytes)).astype(np.int64) if low_bytes < 8 else np.zeros(n, np.int64)
        bits = np.zeros((int(high[-1]) + n if n else 0) // 64 * 64 + 128, np.bool_)
        bits[high + np.arange(n)] = True
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return cls(n, low_bytes, low, words, ones)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for b in range(self.low_bytes):
            out |= self.low[at, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Elements at the given positions."""
        word = np.searchsorted(self.ones, at, "right") - 1
        bit = word * 64 + _select(self.high[word], at - self.ones[word])
        return ((bit - at).astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._low(at) if self.low_bytes < 8 else self._low(at)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """Number of elements whose high bits are below ``high``."""
        rank = np.maximum(high - 1, 0)
        word = np.minimum(np.searchsorted(self.zeros, rank, "right") - 1, len(self.high) - 1)
        bit = word * 64 + _select(~self.high[word], rank - self.zeros[word])
        return np.where(high <= 0, 0, np.minimum(bit - rank, self.length))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, or -1: its bucket of equal high bits, then binary search in the low bits."""
        values = np.asarray(values, np.uint64)
        if not self.length or not len(values):
            return np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(8 * self.low_bytes)).astype(np.int64) if self.low_bytes < 8 else np.zeros(len(values), np.int64)
        beyond = high >= int(self.zeros[-1])
        high = np.where(beyond, 0, high)
        lo, hi = self._before(high), self._before(high + 1)
        end, low = hi.copy(), values & np.uint64((1 << (8 * self.low_bytes)) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        at = np.minimum(lo, self.length - 1)
        return np.where((lo < end) & (self._low(at) == low) & ~beyond, lo, -1)
