"""The random live source as a streaming data source whose offsets carry the clock.

An offset is the number of rows drawn so far and the event time of the next one. Keys and gaps are hashed from the number of the row, so a reader
of any range of rows can draw them without the rows before it; the time it starts at is the offset's plus the gaps in between, which the planner adds up
block by block as it cuts a batch. Any number of tasks serves a batch, a repeated batch draws the same rows, and a restart goes on from the offset.

Register it with ``spark.dataSource.register(RandomSource)``, then ``spark.readStream.format("random_events")`` with the options of ``RandomSource``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from twinweave import model

#: Rows that are drawn at a time.
BLOCK = 1 << 16
#: Gaps between events: whole ms below this.
GAPS = 500


def draws(rows: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """A well mixed 64-bit number for each row number (a counter-based generator after splitmix64)."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * np.uint64(2) + np.uint64(stream)
        x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keys_of(rows: np.ndarray, seed: int, num_keys: int) -> np.ndarray:
    return (draws(rows, seed, 0) % np.uint64(num_keys)).astype(np.int64) + 1


def gaps_of(rows: np.ndarray, seed: int) -> np.ndarray:
    return (draws(rows, seed, 1) % np.uint64(GAPS)).astype(np.int64)


def blocks(first: int, last: int) -> Iterator[np.ndarray]:
    for at in range(first, last, BLOCK):
        yield np.arange(at, min(last, at + BLOCK))


def clock_after(first: int, last: int, clock_ms: int, seed: int) -> int:
    """Event time of row ``last``, if row ``first`` is at ``clock_ms``."""
    return clock_ms + sum(int(gaps_of(rows, seed).sum()) for rows in blocks(first, last))


class Range(InputPartition):
    def __init__(self, first: int, last: int, clock_ms: int):
        super().__init__((first, last))
        self.first, self.last, self.clock_ms = first, last, clock_ms


class RandomReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.num_keys, self.seed = int(options.get("numKeys", 1)), int(options.get("seed", model.SEED_A))
        self.rate, self.partitions_ = float(options.get("rowsPerSecond", 0)), int(options.get("numPartitions", 8))
        self.rows, self.most = int(options.get("rows", 1 << 62)), int(options.get("rowsPerBatch", 1_000_000))
        self.base_ms = int(options.get("baseMs", model.EVENT_TIME_BASE_MS))
        if min(self.num_keys, self.partitions_, self.most) < 1 or self.rate < 0 or self.rows < 0:
            raise ValueError("numKeys, numPartitions and rowsPerBatch must be positive, rowsPerSecond and rows not negative")
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"row": 0, "clock_ms": self.base_ms, "begun": time.time()}

    def latestOffset(self) -> dict:
        if self.last is None:
            self.last = self.initialOffset()
        row, due = self.last["row"], self.rows
        if self.rate:
            due = min(due, int((time.time() - self.last["begun"]) * self.rate))
        upto = max(row, min(due, row + self.most))
        self.last = {"row": upto, "clock_ms": clock_after(row, upto, self.last["clock_ms"], self.seed), "begun": self.last["begun"]}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.last is None or self.last["row"] < end["row"]:
            self.last = dict(end)  # after a restart
        first, last, clock = start["row"], end["row"], start["clock_ms"]
        size = max(1, -(-(last - first) // self.partitions_))
        found = []
        for at in range(first, last, size):
            upto = min(last, at + size)
            found.append(Range(at, upto, clock))
            clock = clock_after(at, upto, clock, self.seed)
        return found

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        clock = part.clock_ms
        for rows in blocks(part.first, part.last):
            gaps = gaps_of(rows, self.seed)
            after = clock + np.cumsum(gaps)
            now = np.full(len(rows), time.time_ns())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (rows, keys_of(rows, self.seed, self.num_keys), np.full(len(rows), model.CONSTANT_VALUE), (after - gaps) * 1000, now)],
                names=["row_id", "key", "value", "event_us", "ingest_ns"])
            clock = int(after[-1])

    def commit(self, end: dict) -> None:
        pass


class RandomSource(DataSource):
    """Options: ``numKeys`` (keys 1..n), ``rowsPerSecond`` (0: as fast as batches go), ``rowsPerBatch``, ``rows`` (in all), ``numPartitions``, ``seed``, ``baseMs``."""

    @classmethod
    def name(cls) -> str:
        return "random_events"

    def schema(self) -> str:
        return "row_id long, key long, value long, event_us long, ingest_ns long"

    def streamReader(self, schema) -> RandomReader:
        return RandomReader(self.options)
