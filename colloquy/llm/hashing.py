"""Vectorised hashes of byte ranges, by prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_POWERS = {b: np.ones(1, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS[base] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
    return _POWERS[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class RangeHashes:
    """Hashes of ranges of ``raw`` (bytes as uint8) that depend on their bytes alone."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw) + 1)[:-1], out=self.sums[1:])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def of_length(self, n: int) -> np.ndarray:
        """For every range of ``n`` bytes."""
        return mixed((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n])
