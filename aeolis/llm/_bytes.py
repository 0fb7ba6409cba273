"""NumPy kernels over the UTF-8 bytes of Arrow string columns.

A batch is worked on in blocks of whole documents of about BLOCK bytes (a longer document is a block
of its own), so memory follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
U64 = np.uint64
#: Bases of two hashes, which together are 128 bits.
BASE, BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F

#: Space and tab to carriage return, the white space of every word rule here.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_SYMBOLS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SYMBOLS_2 = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U64(base)), np.full(n, U64(pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Of base and of its inverse, n of each at least."""
    return _powers(base, max(BLOCK + 1024, 1 << (n - 1).bit_length()))


class Rolling:
    """Hashes of any slices of a byte array, from one pass of prefix sums; second: the other of two hashes."""

    def __init__(self, data: np.ndarray, lower: bool = False, second: bool = False):
        up, self.down = powers(len(data) + 1, BASE_2 if second else BASE)
        symbols = _SYMBOLS_2 if second else _SYMBOLS
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((symbols[LOWER] if lower else symbols)[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(out + (ends - starts).astype(U64))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of each value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole values."""
    raw, at = strings(column)
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of words before it (one more entry for all)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, at)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines (split at \\n; an empty document has one), and lines before each document."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    counts = np.bincount(owner, minlength=len(at) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = at[1:]
    return starts, ends, first


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices without white space at both ends; empty ones as (start, start)."""
    solid = np.flatnonzero(~SPACE[data])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = i < j
    out_s, out_e = starts.copy(), starts.copy()
    out_s[some] = solid[i[some]]
    out_e[some] = solid[j[some] - 1] + 1
    return out_s, out_e


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one document; of fewer words, one for the whole; none for none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, U64)
    for i in range(k):
        out = out * U64(BASE) + word_hashes[i : n - k + 1 + i]
    return mix(out + U64(k))
