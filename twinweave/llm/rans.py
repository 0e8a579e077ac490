"""Static range asymmetric numeral system over token ids, many lanes at a time.

A block spreads its symbols over ``lanes`` independent coders: symbol i belongs to lane ``i % lanes``. All lanes take a step at once as
numpy arrays, and share one stream of 32-bit words. States lie in ``[2**32, 2**64)``. Every ``ROUNDS`` rounds the states and the place
in the stream are kept as a checkpoint, from which decoding may start. Table, words and symbols carry checksums.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from zlib import crc32

import numpy as np

SCALE = 20  # bits of the frequencies' total
LANES = 1024
ROUNDS = 128
_LOW = np.uint64(1 << 32)
_32, _S = np.uint64(32), np.uint64(SCALE)
_HEAD = struct.Struct("<4sIIIIIII")
_MAGIC = b"RNS1"


@dataclass
class Table:
    """Frequencies of all symbols; they add up to ``2**SCALE``."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.freq = self.freq.astype(np.uint64)
        if int(self.freq.sum()) != 1 << SCALE or (self.freq == 1 << SCALE).any():
            raise ValueError("frequencies do not add up, or one symbol has all")
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """From counts: every symbol that occurs gets one at least, rounding goes to the most frequent."""
        counts = np.asarray(counts, np.int64).copy()
        if len(counts) > 1 << (SCALE - 1) or len(counts) < 2:
            raise ValueError("a table has two symbols at least and half the scale at most")
        while (counts > 0).sum() < 2:  # one symbol must not take the whole range
            counts[np.flatnonzero(counts == 0)[0]] = 1
        total = 1 << SCALE
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        short = total - int(freq.sum())
        for s in order[:int((counts > 0).sum())]:
            step = max(short, 1 - int(freq[s]))
            freq[s] += step
            short -= step
            if short == 0:
                break
        return cls(freq)

    def to_bytes(self) -> bytes:
        raw = self.freq.astype("<u4").tobytes()
        return struct.pack("<4sII", b"RNT1", len(self.freq), crc32(raw)) + raw

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        magic, n, check = struct.unpack_from("<4sII", data)
        raw = data[12:12 + 4 * n]
        if magic != b"RNT1" or len(raw) != 4 * n or crc32(raw) != check:
            raise ValueError("damaged frequency table")
        return cls(np.frombuffer(raw, "<u4"))


def encode(symbols: np.ndarray, table: Table) -> bytes:
    """One block."""
    symbols = np.asarray(symbols, np.int64)
    n = len(symbols)
    if n and not table.freq[symbols].all():
        raise ValueError("a symbol has no frequency")
    lanes = max(1, min(LANES, n // 64))
    rounds = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    checkpoints: list[tuple[int, bytes]] = []
    count = 0
    freq, start = table.freq, table.start
    limit_shift = np.uint64(64 - SCALE)
    for r in range(rounds - 1, -1, -1):
        own = symbols[r * lanes:(r + 1) * lanes]
        f, x = freq[own], state[:len(own)]
        over = x >= f << limit_shift
        out = x[over]
        words.append(out.astype(np.uint32))
        count += len(out)
        x = np.where(over, x >> _32, x)
        q = x // f
        state[:len(own)] = (q << _S) + (x - q * f) + start[own]
        if r and r % ROUNDS == 0:
            checkpoints.append((count, state.astype("<u8").tobytes()))
    words.reverse()
    stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
    body = state.astype("<u8").tobytes() + b"".join(struct.pack("<I", count - at) + s for at, s in reversed(checkpoints)) + stream
    return _HEAD.pack(_MAGIC, n, lanes, len(checkpoints), count, len(body), crc32(symbols.astype("<u4").tobytes()), crc32(body)) + body


def size_of(data: bytes, at: int = 0) -> int:
    """Bytes of the block that begins at ``at``."""
    return _HEAD.size + _HEAD.unpack_from(data, at)[5]


def decode(data: bytes, table: Table, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Symbols ``begin..end`` of a block, starting at the last checkpoint before them; all of them are checked by their checksum."""
    magic, n, lanes, points, count, length, ids_check, body_check = _HEAD.unpack_from(data)
    body = data[_HEAD.size:_HEAD.size + length]
    if magic != _MAGIC or len(body) != length or crc32(body) != body_check:
        raise ValueError("damaged block")
    end = n if end is None else min(end, n)
    begin = max(0, min(begin, end))
    state = np.frombuffer(body, "<u8", lanes).astype(np.uint64)
    at, per = 8 * lanes, 4 + 8 * lanes
    stream = np.frombuffer(body, "<u4", count, at + points * per).astype(np.uint64)
    point = min(points, begin // lanes // ROUNDS)
    place = 0
    if point:
        where = at + (point - 1) * per
        place = struct.unpack_from("<I", body, where)[0]
        state = np.frombuffer(body, "<u8", lanes, where + 4).astype(np.uint64)
    first = point * ROUNDS
    last = -(-end // lanes)
    out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    freq, start, symbol = table.freq, table.start, table.symbol
    for r in range(first, last):
        m = min(lanes, n - r * lanes)
        x = state[:m]
        slot = x & low
        s = symbol[slot]
        out[(r - first) * lanes:(r - first) * lanes + m] = s
        x = freq[s] * (x >> _S) + slot - start[s]
        need = x < _LOW
        k = int(np.count_nonzero(need))
        if k:
            x[need] = x[need] << _32 | stream[place:place + k]
            place += k
        state[:m] = x
    found = out[begin - first * lanes:end - first * lanes]
    if begin == 0 and end == n and crc32(found.astype("<u4").tobytes()) != ids_check:
        raise ValueError("damaged symbols")
    return found
