"""Rolling hashes of byte strings with numpy, shared by the byte- and word-level operators."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Prefix hashes of byte strings; the hash of any slice then costs O(1).

    ``seed`` picks the table of byte values, so two instances give
    independent hashes.
    """

    def __init__(self, seed: int = 1):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed))
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            self.up, self.down = _powers(_BASE, size), _powers(_INV, size)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of every k-byte slice."""
        if len(prefix) <= k:
            return np.zeros(0, np.uint64)
        return mix((prefix[k:] - prefix[:-k]) * self.down[: len(prefix) - k])

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the slices ``[start, end)``; the length takes part."""
        h = (prefix[end] - prefix[start]) * self.down[start]
        return mix(mix(h) + (end - start).astype(np.uint64) * np.uint64(_BASE))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, by doubling."""
    s = 1
    while s * 2 <= w:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: -(w - s)], x[w - s :]) if s < w else x


def anchors(g: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some run of ``w`` hashes; ties all count."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    pad = np.zeros(w - 1, np.uint64)
    least = np.concatenate([pad, sliding_min(g, w), pad])
    return np.flatnonzero(g == ~sliding_min(~least, w))
