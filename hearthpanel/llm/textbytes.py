"""Words and rolling hashes over the concatenated UTF-8 bytes of many texts, in numpy."""

from __future__ import annotations

import numpy as np

# An odd base and its inverse give prefix hashes modulo 2**64; random byte values make them uniform.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; a worker keeps the longest asked for."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = ((n >> 20) + 1) << 20
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


class Hashes:
    """Hash of any byte range in constant time; equal strings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * self.up[: len(data)], out=self.prefix[1:], dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.down[starts]

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all strings of ``q`` bytes."""
        n = len(self.prefix) - q
        return (self.prefix[q:] - self.prefix[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, a run of bytes other than white space, of rows that begin at ``offsets``."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1
