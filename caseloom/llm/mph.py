"""A minimal perfect hash of 64-bit keys, with fingerprints.

Level after level, keys are hashed to a bit array twice their number; a key
alone on its bit is placed, the others go on to the next level.  A key's number
is the rank of its bit, found by a stored table of counts a word and a bit count:
a constant number of steps for a key, so ``locate`` finds it in a file by a
constant number of small reads.  Keys that no level can part (equal hashes
at every level) are kept in a sorted list beside them.  A stored fingerprint of
32 bits tells foreign keys.
"""

from __future__ import annotations

import numpy as np

LEVELS = 24
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finalizer of x + seed steps."""
    with np.errstate(over="ignore"):
        x = x.astype("u8") + np.uint64((seed * _STEP) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Index:
    """sizes: bits of each level; words: all levels' bits; ranks: set bits before each word; rest: sorted keys beside."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray, prints: np.ndarray):
        self.sizes, self.words, self.rest, self.prints = sizes, words, rest, prints
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype="i8")))
        self.base = np.concatenate(([0], np.cumsum(sizes)))

    @classmethod
    def build(cls, keys: np.ndarray) -> Index:
        """keys: distinct u8."""
        left, sizes, bits = keys.astype("u8"), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 64) * 64
            at = (mix(left, level + 1) % np.uint64(size)).astype("i8")
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view("<u8")
        index = cls(np.array(sizes, "i8"), words, np.sort(left), np.zeros(len(keys), "u4"))
        index.prints[index.numbers(keys)] = cls.fingerprint(keys)
        return index

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 1000) >> np.uint64(32)).astype("u4")

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key that the index was built of; for others a number of some key or -1."""
        keys = keys.astype("u8")
        out = np.full(len(keys), -1, "i8")
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self.base[level] + (mix(keys[left], level + 1) % np.uint64(size)).astype("i8")
            word, bit = self.words[at >> 6], (at & 63).astype("u8")
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[at[hit] >> 6] + below
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.ranks[-1] + at[hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """As numbers(), but -1 for keys whose fingerprint is another one."""
        n = self.numbers(keys)
        if len(self.prints):
            n[(n < 0) | (self.prints[np.maximum(n, 0)] != self.fingerprint(keys))] = -1
        return n


def locate(key: int, sizes: list[int], word, rank, rest, n_rest: int) -> int:
    """The number of one key, or -1; word(i), rank(i) and rest(i) read an item of these parts of a stored index."""
    at = np.array([key], "u8")
    base = 0
    for level, size in enumerate(sizes):
        spot = base + int(mix(at, level + 1)[0] % np.uint64(size))
        bits = int(word(spot >> 6))
        if bits >> (spot & 63) & 1:
            return int(rank(spot >> 6)) + (bits & ((1 << (spot & 63)) - 1)).bit_count()
        base += size
    low, high = 0, n_rest  # keys that no level could part; hardly ever any
    while low < high:
        middle = (low + high) // 2
        if int(rest(middle)) < key:
            low = middle + 1
        else:
            high = middle
    return int(rank(base >> 6)) + low if low < n_rest and int(rest(low)) == key else -1
