"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * half`` bits have a word in common that is at most ``half`` bits away from either.
So every distinct fingerprint emits all words within ``half`` bits of it, the words are shuffled, and fingerprints
that meet at a word are linked. No more than ``1 + 64 + ...`` distinct fingerprints fit around a word, so groups are
bounded whatever the data; copies were merged before, as only distinct fingerprints take part. Within a group
neighbours in order are linked (all of a group are within the radius of each other), which connects what all pairs
would, without emitting them. Colliding pairs are deduplicated and verified by their distance.

Defined cases: a null or empty text has no shingle and fingerprint zero, which is linked like any other; a text of fewer
words than a shingle has is one shingle; a very long text is read whole; repeated rows have one fingerprint; null ids never become a component's
name unless a component has no other id; of rows that tie for the least id the one of the least hash of its text stays; an empty table has an empty result. Other
columns, whatever they are called, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinweave.llm.components import components
from twinweave.llm.words import slices
from twinweave.session import durable

_STEP = 1 << 15  # shingles whose bits are counted at a time


def fingerprint(text: bytes | None, size: int) -> int:
    """Majority of the bits of all shingle hashes (XXH64, seed 42); A-Z counts as a-z."""
    words = (text or b"").lower().split()  # for bytes: A-Z only, and 0x20, 0x09-0x0D
    if not words:
        return 0
    if len(words) < size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(size))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64, max(1, len(words) - size + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        block = hashes[at:at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            values = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), pa.array(values)], names=["id", "text_key", "fp"])
    return run


def fingerprints(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text_key, fp``: the fingerprint of every whole text as a long."""
    if size < 1:
        raise ValueError("a shingle has at least one word")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints(size), "id long, text_key long, fp long")


def links(distinct: DataFrame, half: int = 1) -> DataFrame:
    """Verified links ``a, b`` between distinct values of column ``fp``; they connect all pairs within ``2 * half`` bits."""
    if half not in (0, 1, 2):
        raise ValueError("half must be 0, 1 or 2")
    masks = [0] + [sum(1 << b for b in bits) for n in range(1, half + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    balls = distinct.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("at"), "fp")
    met = balls.withColumn("other", F.lag("fp").over(Window.partitionBy("at").orderBy("fp"))).where("other is not null")
    return met.select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct().where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, 2 * half))


def group(prints: DataFrame, half: int = 1) -> DataFrame:
    """``fp, component, kept_id, kept_key`` per distinct fingerprint of ``prints`` (``id, text_key, fp``).

    ``component`` is the least id of all documents reachable, and ``kept_id, kept_key`` name one document of them.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_key").alias("key")))
    reps = durable(prints.groupBy("fp").agg(first.alias("first")))
    roots = components(links(reps.select("fp"), half))
    tied = durable(reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = tied.groupBy("root").agg(F.min("first").alias("least"))
    return tied.join(least, "root").select("fp", F.col("least.id").alias("component"), F.col("least.id").alias("kept_id"), F.col("least.key").alias("kept_key"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, size: int = 3, half: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fp, component`` per document: membership of every row, links only between distinct fingerprints."""
    prints = durable(fingerprints(docs, size, doc_id, text))
    groups = group(prints, half).select(F.col("fp").alias("g_fp"), "component")
    # a fingerprint that very many copies share is many small rows on the left; adaptive execution divides them
    return prints.join(groups, prints.fp == groups.g_fp).select("id", "fp", "component")


def deduplicate(docs: DataFrame, size: int = 3, half: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that with the least id (of equal ids, the least hash of the text)."""
    prints = durable(fingerprints(docs, size, doc_id, text))
    keep = group(prints, half).select(*[c.alias(f"k{n}") for n, c in enumerate(_keys(F.col("kept_id"), F.col("kept_key")))]).distinct()
    # the row as one column, so that no name of its columns can meet one of these
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[
        c.alias(f"d{n}") for n, c in enumerate(_keys(F.col(doc_id).cast("long"), F.xxhash64(text)))])
    kept = keyed.join(keep, [F.col(f"d{n}") == F.col(f"k{n}") for n in range(3)], "left_semi")
    # of repeated rows one stays; the rows are already dealt by these keys
    return kept.dropDuplicates(["d0", "d1", "d2"]).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def _keys(doc: Column, text_key: Column) -> list[Column]:
    """A row's name without nulls."""
    return [F.coalesce(doc, F.lit(0)), doc.isNull(), text_key]
