"""A minimal perfect hash in NumPy: levels of bit arrays, each keeping the keys that met no other there."""

from __future__ import annotations

import numpy as np

from ._bytes import U64, mix


class PerfectHash:
    """Numbers distinct 64-bit keys 0 to n - 1 in about 3 to 4 bits a key. Other keys get any number or -1."""

    GAMMA = 2.0

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        done = 0
        while len(keys):
            size = max(64, int(self.GAMMA * len(keys)) + 63 & ~63)
            at = self._at(keys, len(self.levels), size)
            once = np.bincount(at, minlength=size) == 1
            ranks = np.concatenate([[0], np.cumsum(once.reshape(-1, 64).sum(1))]) + done
            self.levels.append((np.packbits(once, bitorder="little"), ranks))
            done += int(once.sum())
            keys = keys[~once[at]]
        self.n = done

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64(level * 0x9E3779B97F4A7C15 % 2**64)) % U64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self.levels):
            at = self._at(keys[left], level, len(bits) * 8)
            hit = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            word = at[hit] >> 6
            # Set bits of the word before this one.
            whole = np.ascontiguousarray(bits).view("<u8")[word] & ((U64(1) << (at[hit] & 63).astype(U64)) - U64(1))
            out[left[hit]] = ranks[word] + np.bitwise_count(whole)
            left = left[~hit]
            if not len(left):
                break
        return out
