"""What both byte-pair codecs use: a table of pairs, and parts joined by number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Values of pairs of symbols, as an open hash table: a pair takes the first free
    slot from its home on."""

    def __init__(self, left: np.ndarray, right: np.ndarray, width: int, *values: np.ndarray, missing: int = -1):
        self.width = np.int64(width)
        keys = left.astype(np.int64) * width + right
        self.bits = (8 * len(keys) + 8).bit_length()
        slots, home, rest = np.full(1 << self.bits, -1), self._home(keys), np.arange(len(keys))
        while len(rest):
            free = rest[slots[home[rest]] < 0]
            slots[home[free]] = free
            rest = rest[slots[home[rest]] != rest]
            home[rest] = (home[rest] + 1) & (len(slots) - 1)
        self.keys = np.append(keys, -1)[slots]
        self.values = [np.append(v, v.dtype.type(missing))[slots] for v in values]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        """The values of each pair, ``missing`` where it isn't in the table."""
        key = left.astype(np.int64) * self.width + right
        at = self._home(key)
        rest = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[at[rest]]
            rest = rest[(there != key[rest]) & (there >= 0)]
        return [v[at] for v in self.values]


def joined(parts: pa.BinaryArray, at: np.ndarray) -> bytes:
    """The parts at the given places, one after another."""
    data = parts.take(pa.array(at)).buffers()[2] if len(at) else None
    return data.to_pybytes() if data else b""
