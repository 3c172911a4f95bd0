"""Minimal perfect hashing: n distinct 64-bit keys get the slots 0 to n - 1, in about three bits a key."""

from __future__ import annotations

import numpy as np

from siftlab.llm.words import mix

_SPACE = 2  # bits a level has for each of its keys
_STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    """A cascade of bit arrays: a key lives on the first level where it was alone on its bit.

    Its slot is the number of bits set before its own. Keys that were not given at the build find
    no bit or the slot of another key, so callers keep the keys by slot and compare.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @staticmethod
    def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(_STEP * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """``keys`` are distinct."""
        left, sizes, words = keys.astype(np.uint64), [], []
        while len(left):
            size = -(-_SPACE * len(left) // 64) * 64
            at = cls._bits(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self._bits(keys[open_], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            word, bit = word[here], bit[here]
            out[open_[here]] = self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            open_, base = open_[~here], base + (size >> 6)
        return out

    def by_slot(self, keys: np.ndarray) -> np.ndarray:
        """The keys of the build in the order of their slots."""
        out = np.zeros(len(keys), np.uint64)
        out[self.slots(keys)] = keys
        return out

    def dump(self) -> bytes:
        return np.concatenate([[len(self.sizes)], self.sizes, self.words.view(np.int64)]).astype("<i8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> "PerfectHash":
        values = np.frombuffer(data, "<i8")
        n = int(values[0])
        return cls(values[1 : n + 1], values[n + 1 :].view(np.uint64))


class KeyedVector:
    """Values by perfect hash, with the keys to verify that a slot is a key's own."""

    def __init__(self, table: PerfectHash, keys: np.ndarray, values: np.ndarray):
        self.table, self.keys, self.values = table, keys, values

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 for keys the table does not hold."""
        slots = self.table.slots(keys)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        held = (slots >= 0) & (self.keys[slots] == keys.astype(np.uint64))
        return np.where(held, self.values[slots], -1)
