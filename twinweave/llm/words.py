"""Words of many texts at once, by numpy over the buffers of an Arrow column.

Used inside Arrow tasks. Nothing here is per row: a slice of some megabytes of text becomes arrays of
word starts, word ends and 64-bit word hashes, from which windows of words are hashed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text one numpy step works on; a longer text is a step of its own.
SLICE_BYTES = 4 << 20
_CHUNKS = 32  # words beyond 8 * 32 bytes are hashed one by one
_MIX_1, _MIX_2, _ROLL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)

#: Bytes that are no white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and every byte beyond ASCII, once A-Z is lower case.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit value for each value."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more for the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column``."""
    for batch in batches:
        bounds = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            before = bounds[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(bounds, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Words of a slice: ``first[i]:first[i + 1]`` are those of row i, ``data[starts[j]:ends[j]]`` is word j."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, by its bytes."""
        sizes = self.ends - self.starts
        out = mixed(sizes.astype(np.uint64) * _ROLL)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        live = np.arange(len(sizes))
        for k in range(0, 8 * _CHUNKS, 8):
            if not live.size:
                return out
            part = eights[self.starts[live] + k].view("<u8").ravel() & _MASKS[np.minimum(sizes[live] - k, 8)]
            out[live] = mixed((out[live] ^ part) * _ROLL + np.uint64(k + 1))
            live = live[sizes[live] > k + 8]
        for j in live:
            out[j] = xxhash.xxh64_intdigest(self.data[self.starts[j]:self.ends[j]].tobytes(), 7)
        return out

    def window_starts(self, size: int) -> np.ndarray:
        """Word numbers at which ``size`` words of one row begin."""
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self.starts))
        return at[at + size <= last]


def words_of(column: pa.Array, kept: np.ndarray, lower: bool = False) -> Words:
    """Runs of bytes for which ``kept`` holds; no word reaches over two rows."""
    data, offsets = flat(column)
    if lower:
        data = _LOWER[data]
    inside = kept[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(data, offsets, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` neighbouring values; the last ``size - 1`` places are not meaningful."""
    total, done, power, block, n = np.zeros_like(hashes), 0, _ROLL, hashes, size
    shift = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])
    length = 1
    with np.errstate(over="ignore"):
        while n:
            if n & 1:
                total = total * power + shift(block, done)
                done += length
            n >>= 1
            if n:
                block = block * power + shift(block, length)
                power, length = power * power, length * 2
    return mixed(total)
