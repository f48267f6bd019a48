"""Hashes of all pieces of a byte buffer, by prefix sums."""

from __future__ import annotations

import numpy as np

_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 2**64)
#: Powers come from two tables, of the low and the high part of the exponent.
_LOW_BITS = 16
_LOW = 1 << _LOW_BITS
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for the next call."""
    if len(_kept.get(base, ())) < n:
        x = np.full(max(n, 1024), base % 2**64, dtype=np.uint64)
        x[0] = 1
        _kept[base] = np.multiply.accumulate(x)
    return _kept[base][:n]


class PieceHash:
    """64-bit hashes of pieces of a buffer; equal bytes have equal hashes in every buffer.

    A piece's polynomial is a difference of two prefix sums, times an inverse
    power of the base that moves it to the front. All vectors of pieces cost the
    same, however long the pieces are.
    """

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        term = self._sums[1:]
        term[:] = flat
        term += np.uint64(1)
        low, high = _powers(_BASE, _LOW), _powers(pow(_BASE, _LOW, 2**64), (n >> _LOW_BITS) + 1)
        for k in range((n + _LOW - 1) >> _LOW_BITS):
            part = term[k << _LOW_BITS : (k + 1) << _LOW_BITS]
            part *= low[: len(part)]
            part *= high[k]
        np.cumsum(term, out=term)
        self._low, self._high = _powers(_INVERSE, _LOW), _powers(pow(_INVERSE, _LOW, 2**64), (n >> _LOW_BITS) + 1)

    def __call__(self, first: np.ndarray, last: np.ndarray, kind: int = 0) -> np.ndarray:
        """Hash of each piece [first, last); ``kind`` keeps pieces of different use apart."""
        with np.errstate(over="ignore"):
            h = self._sums[last] - self._sums[first]
            h *= self._low[first & (_LOW - 1)]
            h *= self._high[first >> _LOW_BITS]
            h += np.uint64((kind + 1) * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))


def blank_words(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) byte of each word; the six ASCII blanks separate words."""
    word = (flat != 32) & ((flat < 9) | (flat > 13))
    step = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    return step[0::2], step[1::2]
