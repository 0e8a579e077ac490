"""Packing along a space-filling curve.

Each document becomes token ids and a hashed vector: ids fall into ``BUCKETS`` by hash, the logarithms of their counts are scaled to length one
and projected to three dimensions by fixed signs. Coordinates are spread over the range that all documents take, and their Hilbert
key puts documents with similar words next to each other. Documents are sorted by that key with a range shuffle of small rows (key,
length, row), and laid end to end along the curve. A sequence is the next ``width`` places of that line, so only the last sequence
of the whole data set has padding; a document is cut where a sequence ends.

Steps: (1) ids and vectors are written once to the shared folder; (2) the small rows are range-sorted and counted per range, ranges are put
one after the other; (3) ids join their place by row number, and every document is cut by itself. No step holds more than a slice of
documents, and copies, long documents and hot sources are rows like others.

Defined cases: null and empty texts are documents of one id, the end; equal texts have equal keys and follow each other in order of id; repeated
rows are documents of their own; an empty table packs to nothing. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from twinweave.llm.tokens import ENCODED_BYTES, END, encoder
from twinweave.llm.words import mixed, slices
from twinweave.session import durable

WIDTH = 2048
BUCKETS = 256
DIMENSIONS = 3
BITS = 20  # of the curve, for each dimension
_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"


def _projection() -> np.ndarray:
    """Fixed signs: bucket by dimension."""
    bits = mixed(np.arange(BUCKETS * DIMENSIONS, dtype=np.uint64) + np.uint64(1)) & np.uint64(1)
    return (2.0 * bits.reshape(BUCKETS, DIMENSIONS) - 1) / np.sqrt(BUCKETS)


def vector(ids: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    counts = np.log1p(np.bincount(bucket[ids], minlength=BUCKETS))
    return counts / max(1e-12, float(np.sqrt((counts * counts).sum())))


def hilbert_keys(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of grid places (Skilling's transform, all rows at once)."""
    x = places.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] ^= np.where(high, p, swap)
            x[i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _tokens(file: str, spaced: bool, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file, spaced, added)
        kind = "<u2" if own.vocabulary <= 1 << 16 else "<u4"
        bucket = (mixed(np.arange(max(1 << 16, own.vocabulary), dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        signs = _projection()
        for part in slices(batches, size=ENCODED_BYTES):
            ids = [np.append(x, END).astype(kind) for x in own.encode(part.column("text"))]
            at = np.array([vector(x, bucket) for x in ids]) @ signs
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), *map(pa.array, at.T)],
                names=["id", "ids", "n", *(f"x{k}" for k in range(DIMENSIONS))])
    return run


def tokenized(docs: DataFrame, file: str, spaced: bool, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """``row, id, ids, n, x0, x1, x2`` in the shared folder; ``ids`` holds numbers of 16 bits, little endian, or of 32 for vocabularies beyond 65,536."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    kind = "id long, ids binary, n long, " + ", ".join(f"x{k} double" for k in range(DIMENSIONS))
    return durable(rows.mapInArrow(_tokens(file, spaced, added), kind).withColumn("row", F.monotonically_increasing_id()))


def _keys(low: list[float], high: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, span = np.array(low), np.maximum(np.array(high) - np.array(low), 1e-12)
        for batch in batches:
            x = np.column_stack([batch.column(f"x{k}").to_numpy() for k in range(DIMENSIONS)])
            grid = np.clip((x - floor) / span * (2 ** BITS - 1), 0, 2 ** BITS - 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("n"), pa.array(hilbert_keys(grid))], names=["row", "id", "n", "key"])
    return run


def positions(tokens: DataFrame) -> DataFrame:
    """``row, position``: tokens before each document along the curve."""
    ends = tokens.agg(*[f(f"x{k}").alias(f"{n}{k}") for n, f in (("low", F.min), ("high", F.max)) for k in range(DIMENSIONS)]).first()
    low, high = ([ends[f"{n}{k}"] or 0.0 for k in range(DIMENSIONS)] for n in ("low", "high"))
    light = tokens.select("row", "id", "n", *(f"x{k}" for k in range(DIMENSIONS))).mapInArrow(_keys(low, high), "row long, id long, n long, key long")
    order = ["key", "id", "row"]
    ranges = durable(light.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # one small row per range: as few as a global sort has partitions
    sums = ranges.groupBy("part").agg(F.sum("n").alias("total"))
    base = sums.select(F.col("part").alias("b_part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return ranges.withColumn("within", within).join(base, F.col("part") == F.col("b_part")).select(
        F.col("row").alias("p_row"), (F.col("base") + F.col("within")).alias("position"))


def _cut(width: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids"):
            out: list[tuple] = []
            kept: list[bytes] = []
            for doc, raw, n, position in zip(*(part.column(c).to_pylist() for c in ("id", "ids", "n", "position"))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(position + start, width)
                    length = min(n - start, width - offset)
                    own = ids[4 * start:4 * (start + length)]
                    out.append((doc, start, length, crc32(own), n, sequence, offset))
                    if with_ids:
                        kept.append(own)
                    start += length
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)
    return run


def pack(docs: DataFrame, file: str, spaced: bool = True, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
         added: bool = False) -> DataFrame:
    """A row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence, offset`` (and ``ids``, 32-bit little endian). ``added``: as in ``tokens``."""
    if width < 1:
        raise ValueError("a sequence has at least one place")
    tokens = tokenized(docs, file, spaced, doc_id, text, added)
    placed = tokens.select("row", "id", "ids", "n").join(positions(tokens), F.col("row") == F.col("p_row")).select("id", "ids", "n", "position")
    return placed.mapInArrow(_cut(width, with_ids), _PIECES + (", ids binary" if with_ids else ""))


def _padded(width: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = np.array([pad], "<u4").tobytes()
        for batch in batches:
            rows = []
            for pieces in batch.column("pieces").to_pylist():
                ids = b"".join(p["ids"] for p in sorted(pieces, key=lambda p: p["offset"]))
                rows.append((ids + filler * (width - len(ids) // 4), len(ids) // 4))
            yield pa.RecordBatch.from_arrays([batch.column("sequence"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                                             names=["sequence", "ids", "filled"])
    return run


def sequences(pieces: DataFrame, width: int = WIDTH, pad: int = 0) -> DataFrame:
    """``sequence, ids, filled``: whole sequences of ``width`` ids from pieces with ids; a group has ``width`` ids at most."""
    grouped = pieces.groupBy("sequence").agg(F.collect_list(F.struct("offset", "ids")).alias("pieces"))
    return grouped.mapInArrow(_padded(width, pad), "sequence long, ids binary, filled long")
