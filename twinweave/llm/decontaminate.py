"""Benchmark decontamination: a broadcast hash set of test n-grams against all token windows.

Words are runs of letters, digits and non-ASCII characters, with A-Z in lower case. Every window of ``size``
words of an item is put into a hash table (an item with fewer words is one window of its own length); the tables
are broadcast, and each task looks its documents' windows up in them. A hit of hashes is verified word by word.
Nothing is shuffled.

The broadcast is bounded: items are dealt into blocks of about ``BLOCK_BYTES`` of text by hash, and only one block
is broadcast at a time; equal items count once, and every item counts some bytes besides its text. A benchmark larger than one block takes one pass over the documents per block, and
the sparse hits of the passes are merged; the result is the same.

Defined cases: null or empty text has no words and no hit; repeated documents and repeated items are judged alike
(an item id is reported once); a null item text has no window; an empty table of items hits nothing; null document ids
are kept; a very long text is read whole; ties do not arise, as nothing is ranked. Items with a null id are left out by ``find_hits`` unless ``nameless`` is set; then they hit like others and stand as
one null at the end of ``items``. ``op7_decontamination`` and ``decontaminate`` look at all items. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from twinweave.llm.words import WORD_BYTES, Words, rolled, slices, words_of
from twinweave.session import durable

#: Bytes of item text in one broadcast; the table made of it takes about six times as much.
BLOCK_BYTES = 8 << 20
#: What a row counts besides its text and name, so that a block of short items is bounded too.
ROW_BYTES = 64
HITS = "id long, text_key long, n_words long, hits array<struct<first:long,last:long,start:long,stop:long>>, items array<string>"


class Table:
    """The windows of one block of items."""

    def __init__(self, names: list[str | None], texts: pa.Array, size: int):
        words = words_of(texts, WORD_BYTES, lower=True)
        hashes, counts, row = words.hashes(), words.counts, words.row_of()
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, dict[int, dict[bytes, list[str | None]]]]] = {}
        for length in sorted({min(size, int(n)) for n in counts if n}):
            starts = words.window_starts(length)
            if length < size:
                starts = starts[counts[row[starts]] == length]
            else:
                starts = starts[counts[row[starts]] >= size]
            keys = rolled(hashes, length)[starts]
            exact: dict[int, dict[bytes, list[str | None]]] = {}
            for key, at in zip(keys.tolist(), starts.tolist()):
                owners = exact.setdefault(key, {}).setdefault(_joined(words, at, length), [])
                if not owners or owners[-1] != names[row[at]]:
                    owners.append(names[row[at]])
            marks = np.zeros(1 << max(12, int(16 * len(keys)).bit_length()), bool)
            marks[keys & np.uint64(len(marks) - 1)] = True
            self.by_size[length] = (marks, np.unique(keys), exact)

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """First word, number of words and item names of each occurrence."""
        hashes = words.hashes()
        for length, (marks, keys, exact) in self.by_size.items():
            starts = words.window_starts(length)
            found = rolled(hashes, length)[starts]
            near = marks[found & np.uint64(len(marks) - 1)]
            starts, found = starts[near], found[near]
            sure = keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found
            for key, at in zip(found[sure].tolist(), starts[sure].tolist()):
                owners = exact[key].get(_joined(words, at, length))
                if owners:
                    yield at, length, owners


def _joined(words: Words, at: int, n: int) -> bytes:
    return b" ".join(words.data[words.starts[j]:words.ends[j]].tobytes() for j in range(at, at + n))


def _scan(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Table = block.value
        for part in slices(batches):
            words = words_of(part.column("text"), WORD_BYTES, lower=True)
            cover = np.zeros(len(words.starts) + 1, np.int64)
            names: dict[int, set[str | None]] = {}
            row = words.row_of()
            for at, n, owners in table.hits(words):
                cover[at] += 1
                cover[at + n] -= 1
                names.setdefault(int(row[at]), set()).update(owners)
            hit = np.cumsum(cover)[:-1] > 0
            # runs of hit words, cut where a row ends
            new = hit.copy()
            new[1:] &= ~hit[:-1]
            new[words.first[:-1][words.counts > 0]] |= hit[words.first[:-1][words.counts > 0]]
            end = hit.copy()
            end[:-1] &= ~hit[1:] | new[1:]
            first, last = np.flatnonzero(new), np.flatnonzero(end)
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for i, j in zip(first.tolist(), last.tolist()):
                r = int(row[i])
                base = int(words.offsets[r])
                spans[r].append({"first": i - int(words.first[r]), "last": j - int(words.first[r]),
                                 "start": int(words.starts[i]) - base, "stop": int(words.ends[j]) - base})
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("text_key"), pa.array(words.counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "stop")]))),
                pa.array([sorted(names.get(r, ()), key=lambda x: (x is None, x or "")) for r in range(part.num_rows)], pa.list_(pa.string()))],
                names=["id", "text_key", "n_words", "hits", "items"])
    return run


def find_hits(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", item_id: str = "item_id",
              text: str = "text", block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """Per document: ``id, text_key, n_words``, runs of hit words (``hits``: word numbers ``first..last`` and the bytes
    ``start..stop`` of the UTF-8 text) and the sorted ids of the items with occurring windows (``items``).

    ``nameless``: also look for items with a null id."""
    spark = docs.sparkSession
    if size < 1:
        raise ValueError("size must be at least 1")
    tests = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).where("text is not null" if nameless else "name is not null and text is not null").distinct()
    total = tests.agg(F.sum(F.octet_length("text").cast("long") + F.coalesce(F.octet_length("name"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))

    def one(k: int) -> DataFrame:
        mine = (tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)).toArrow()
        texts = mine.column("text").combine_chunks()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        table = Table(mine.column("name").to_pylist(), texts, size)
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(table)), HITS)

    if blocks == 1:
        return one(0)
    passes = None
    for k in range(blocks):
        # only what was hit is kept of a pass; the table of a block is let go before the next is made
        hit = durable(one(k).where("size(hits) > 0"))
        passes = hit if passes is None else passes.unionByName(hit)
    counted = rows.mapInArrow(_scan(spark.sparkContext.broadcast(Table([], pa.array([], pa.string()), size))), HITS).drop("hits", "items")
    # rows with equal id and text have equal hits and items, so one of them per pass is enough; other passes may have equal hits of other items
    merged = passes.dropDuplicates(["id", "text_key", "hits", "items"]).groupBy("id", "text_key").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.select(F.col("id").alias("m_id"), F.col("text_key").alias("m_key"), _united("hits").alias("hits"), "items")
    out = counted.join(merged, counted.id.eqNullSafe(merged.m_id) & counted.text_key.eqNullSafe(merged.m_key), "left")
    none = "array<struct<first:long,last:long,start:long,stop:long>>"
    return out.select("id", "text_key", "n_words", F.coalesce("hits", F.array().cast(none)).alias("hits"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _united(hits: str) -> Column:
    """Runs that overlap or touch become one, as they are within one pass."""
    kind = "array<struct<first:long,last:long,start:long,stop:long>>"

    def add(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        grown = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"),
                         top["start"].alias("start"), F.greatest(top["stop"], x["stop"]).alias("stop"))
        apart = (F.size(done) == 0) | (x["first"] > F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown)))
    return F.aggregate(F.array_sort(hits), F.array().cast(kind), add)


def hit_words(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for text, hits in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            if text is not None and hits:
                raw, at, kept = text.encode(), 0, []
                for x in hits:
                    kept.append(raw[at:x["start"]])
                    at = x["stop"]
                text = b"".join([*kept, raw[at:]]).decode()
            done.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(done, pa.string())], names=["doc", "text"])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, action: str = "document", doc_id: str = "doc_id",
                  item_id: str = "item_id") -> DataFrame:
    """The documents without those that are hit (``action="document"``), or without their hit words (``"span"``).

    Columns stay as they are. Rows with equal id and text get the same decision. The hits are sparse: only documents
    that are hit take part in the join on the right side.
    """
    if action not in ("document", "span"):
        raise ValueError("action must be document or span")
    hit = durable(find_hits(docs, items, size, doc_id, item_id, nameless=True).where("size(hits) > 0").select(
        F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), F.col("hits").alias("runs")).dropDuplicates(["hit_id", "hit_key"]))
    # the row as one column, so that no name of its columns can meet one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(doc_id).cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & F.col("own_key").eqNullSafe(F.col("hit_key"))
    if action == "document":
        return rows.join(hit, same, "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
    joined = rows.join(hit, same, "left").select("doc", F.col("doc")["text"].alias("text"), "runs")
    cut = joined.mapInArrow(_cut, StructType([StructField("doc", rows.schema["doc"].dataType), StructField("text", StringType())]))
    return cut.select(*[F.col("text").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
