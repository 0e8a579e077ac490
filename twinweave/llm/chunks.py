"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where it is small. The bound is normalised: strict up to ``NORMAL`` bytes, lenient from
there to ``MOST``, and none before ``LEAST``, so sizes stay near the normal one. Boundaries depend on the bytes just before them, so after an
insertion or a deletion they fall in step again. A fingerprint is the sorted set of the chunks, each 48 bits of digest and one byte of
length; ``likeness`` is the length of the common chunks over that of the smaller set, which measures containment.

The pairs of neighbouring documents need each document's successor in descending order of id. Ids are cut in blocks of about ``BLOCK_ROWS``
documents at approximate quantiles, but in no more blocks than a shuffle has partitions (``MOST_BLOCKS`` at least): as few numbers on the driver as a global sort keeps.
Every block is one partition, and the first document of a
block is also sent to the block before it. So texts are shuffled once and read in order; a task holds a slice of them, however large its block is.

Defined cases: null text is empty, and the empty text's fingerprint is empty: equal to itself (likeness 1) and to nothing else (0);
rows of equal id follow each other in order of text and lie in one block, null ids in that of the least id there is; null ids come last; a lone document is its own successor; very long
texts are read whole; an empty table has an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from twinweave.llm.words import Words, mixed, slices
from twinweave.session import task_slots

LEAST, NORMAL, MOST = 16, 48, 128
BLOCK_ROWS = 5000
MOST_BLOCKS = 200
_STRICT, _LENIENT = np.uint32(1 << 26), np.uint32(1 << 28)
_GEAR = (mixed(np.arange(256, dtype=np.uint64) + np.uint64(256)) >> np.uint64(32)).astype(np.uint32)
_NO_ID = -(1 << 63)
PAIRS = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gear(data: np.ndarray) -> np.ndarray:
    """Hash of the ``LEAST`` bytes up to each place: the sum of ``gear[byte] << distance``, by doubling."""
    h = _GEAR[data]
    span = 1
    while span < LEAST:
        before = h.copy()
        h[span:] += before[:-span] << np.uint32(span) if len(h) > span else 0
        span *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of all texts end; every text that is not empty ends a chunk."""
    h = gear(data)
    strict, lenient = np.flatnonzero(h < _STRICT).tolist(), np.flatnonzero(h < _LENIENT).tolist()
    out: list[int] = []
    i = j = 0
    bounds = offsets.tolist()
    for start, end in zip(bounds, bounds[1:]):
        while end - start > LEAST:
            # a byte at place p may end the chunk that p + 1 - start bytes long is
            normal, most = min(start + NORMAL, end), min(start + MOST, end)
            i = bisect_left(strict, start + LEAST - 1, i)
            if i < len(strict) and strict[i] < normal:
                start = strict[i] + 1
            else:
                j = bisect_left(lenient, normal - 1, j)
                start = lenient[j] + 1 if j < len(lenient) and lenient[j] < most else most
            out.append(start)
        if start < end:
            out.append(end)
    return np.array(out, np.int64)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted chunk set of each text: 48 bits of digest, then length - 1 in eight bits."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [np.empty(0, np.uint64)] * len(texts)
    ends = chunk_ends(data, offsets)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, offsets)
    digest = Words(data, offsets, starts, ends, first).hashes()
    values = (digest >> np.uint64(16) << np.uint64(8)) | (ends - starts - 1).astype(np.uint64)
    return [np.unique(values[a:b]) for a, b in zip(first, first[1:])]


def text_of(chunks: np.ndarray) -> str:
    """A fingerprint as a string: fourteen hexadecimal digits per chunk."""
    return np.ascontiguousarray(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 7)
    return np.concatenate([np.zeros((len(raw), 1), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes of common chunks over those of the smaller set."""
    weight = lambda x: int((x & np.uint64(255)).sum()) + len(x)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return weight(np.intersect1d(a, b, assume_unique=True)) / min(weight(a), weight(b))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the other text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None  # block, whether a copy, id, text, fingerprint
    for part in slices(batches, size=1 << 21):
        texts = [t or "" for t in part.column("text").to_pylist()]
        prints = fingerprints([t.encode() for t in texts])
        rows = list(zip(part.column("block").to_pylist(), part.column("copy").to_pylist(), part.column("id").to_pylist(), texts, prints))
        pairs = [(a, b) for a, b in zip([before, *rows], rows) if a is not None and not a[1] and a[0] == b[0]]
        before = rows[-1] if rows else before
        changed = [edited(a[3], b[3]).encode() for a, b in pairs]
        found = fingerprints(changed)
        yield pa.RecordBatch.from_arrays([
            pa.array([None if a[2] == _NO_ID else a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([sha256(c).hexdigest() for c in changed], pa.string()), pa.array([text_of(a[4]) for a, _ in pairs], pa.string()),
            pa.array([text_of(f) for f in found], pa.string()), pa.array([likeness(a[4], f) for (a, _), f in zip(pairs, found)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64())], names=[c.split()[0] for c in PAIRS.split(", ")])


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Columns ``PAIRS`` for every document: its fingerprint, that of its edited text, and how near the edited and the next one are."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    ids = rows.select("id")
    blocks = max(1, min(-(-ids.count() // block_rows), max(MOST_BLOCKS, task_slots(docs.sparkSession))))
    cuts: list[float] = []
    if blocks > 1:
        shares = [k / blocks for k in range(1, blocks)]
        found = ids.agg(F.percentile_approx("id", shares, max(10_000, 10 * blocks)).alias("cuts")).first()["cuts"]
        cuts = sorted({float(c) for c in found})
    bucket = Bucketizer(splits=[-np.inf, *(cuts or [0.0]), np.inf], inputCol="place", outputCol="bucket")

    def dealt(frame: DataFrame) -> DataFrame:
        """``block`` counts in descending order of id."""
        return bucket.transform(frame.withColumn("place", F.col("id").cast("double"))).withColumn(
            "block", (F.lit(len(bucket.getSplits()) - 2) - F.col("bucket")).cast("int")).drop("place", "bucket")

    # a row per block, like the cuts
    order = Window.orderBy("block")
    heads = dealt(ids).groupBy("block").agg(F.max("id").alias("head")).select(
        "head", F.coalesce(F.lag("block").over(order), F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("target"))
    sent = dealt(rows).join(F.broadcast(heads), F.col("id") == F.col("head"), "left")
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("copy"))
    both = F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("target").alias("block"), F.lit(True).alias("copy"))))
    placed = sent.select("id", "text", F.explode(both).alias("to")).select("id", "text", "to.block", "to.copy")
    ordered = placed.repartitionById(len(bucket.getSplits()) - 1, F.col("block")).sortWithinPartitions("block", "copy", F.desc("id"), "text")
    return ordered.mapInArrow(_pairs, PAIRS)
