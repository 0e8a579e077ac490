"""Token ids in binary files, coded by a static range asymmetric numeral system.

A range shuffle sorts the texts by document id, and each task writes files of independent blocks: whole documents up to about
``BLOCK_TOKENS`` ids, with the documents' ids and lengths, checkpoints and checksums. The blocks of a file share one frequency table, made
of all ids of the file: a task holds ``FILE_TOKENS`` ids (16 bits each), counts them, and then codes them. So texts are tokenised once, and
nothing but the texts is shuffled.

A file is a head (``TKF1``, length, the frequency table), then blocks. The index table names every block; its rows are dealt to tasks, and
each block is decoded by itself. Where a document starts in the whole data set follows from sums over ranges, blocks and documents.

Defined cases: null and empty texts are documents of one id, the end; rows of equal id follow each other in order of text; null ids come
first; a document longer than a block is a block of its own; an empty table gives no file. Other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from twinweave.llm.files import Reader, Writer
from twinweave.llm.rans import Table, decode, encode
from twinweave.llm.tokens import ENCODED_BYTES, END, encoder
from twinweave.llm.words import slices
from twinweave.session import durable, fresh_dir

BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 23
_MAGIC = b"TKF1"
_BLOCK = struct.Struct("<4sII")
INDEX = "part long, number long, path string, place long, size long, docs long, tokens long"
DOCS = "id long, start long, n_tokens long, ids_crc32 long"
READ_BLOCKS = 8  # neighbouring blocks, mostly of one file, that a task reads


def block_bytes(ids: list[int | None], tokens: list[np.ndarray], table: Table) -> bytes:
    """A block: sizes, the zipped document table, and the coded ids."""
    nulls = np.array([i is None for i in ids], np.uint8).tobytes()
    heads = zlib.compress(nulls + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([len(t) for t in tokens], "<u4").tobytes())
    coded = encode(np.concatenate(tokens), table)
    return _BLOCK.pack(b"TKB1", len(ids), len(heads)) + struct.pack("<I", zlib.crc32(heads)) + heads + coded


def block_docs(raw: bytes, table: Table) -> tuple[list[int | None], list[np.ndarray]]:
    magic, n, length = _BLOCK.unpack_from(raw)
    at = _BLOCK.size + 4
    heads = raw[at:at + length]
    if magic != b"TKB1" or zlib.crc32(heads) != struct.unpack_from("<I", raw, _BLOCK.size)[0]:
        raise ValueError("damaged block head")
    heads = zlib.decompress(heads)
    ids = np.frombuffer(heads, "<i8", n, n)
    sizes = np.frombuffer(heads, "<u4", n, 9 * n).astype(np.int64)
    symbols = decode(raw[at + length:], table)
    return [None if null else int(i) for null, i in zip(heads[:n], ids)], np.split(symbols, np.cumsum(sizes)[:-1])


def _written(folder: str, file: str, spaced: bool, block_tokens: int, file_tokens: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file, spaced, added)
        part, number, rows = TaskContext.get().partitionId(), 0, []
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = 0

        def write_file() -> None:
            nonlocal number, ids, held, tokens
            table = Table.of(np.bincount(np.concatenate(held), minlength=own.vocabulary))
            packed = zlib.compress(table.to_bytes())
            now = Writer(folder, ".tokens")
            now.write(_MAGIC + struct.pack("<I", len(packed)) + packed)
            begin = 0
            while begin < len(held):
                end, size = begin, 0
                while end < len(held) and (end == begin or size + len(held[end]) <= block_tokens):
                    size += len(held[end])
                    end += 1
                raw = block_bytes(ids[begin:end], held[begin:end], table)
                rows.append((part, number, now.uri, now.size, len(raw), end - begin, size))
                now.write(raw)
                number, begin = number + 1, end
            now.close()
            ids, held, tokens = [], [], 0

        for batch in slices(batches, size=ENCODED_BYTES):
            for doc, found in zip(batch.column("id").to_pylist(), own.encode(batch.column("text"))):
                ids.append(doc)
                held.append(np.append(found, END).astype(np.uint16 if own.vocabulary <= 1 << 16 else np.uint32))
                tokens += len(found) + 1
                if tokens >= file_tokens:
                    write_file()
        if tokens:
            write_file()
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=[c.split()[0] for c in INDEX.split(", ")])
    return run


def write(docs: DataFrame, file: str, spaced: bool = False, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
          block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS, added: bool = False) -> DataFrame:
    """Write the ids of all documents in ascending order of id; returns the index, a row per block. Files lie below ``folder`` (default: a new
    one in the shared folder, which goes when this process ends). ``added``: as in ``tokens``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # texts decide only between rows of equal id
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    run = _written(folder or fresh_dir(docs.sparkSession, "tokens"), file, spaced, block_tokens, file_tokens, added)
    return durable(ordered.mapInArrow(run, INDEX))


@lru_cache(maxsize=2)
def _table(packed: bytes) -> Table:
    return Table.from_bytes(zlib.decompress(packed))


def read_block(path: str, place: int, size: int) -> tuple[list[int | None], list[np.ndarray]]:
    file = Reader(path)
    try:
        head = file.range(0, 8)
        if head[:4] != _MAGIC:
            raise ValueError(f"{path} is no token file")
        return block_docs(file.range(place, place + size), _table(file.range(8, 8 + struct.unpack("<I", head[4:])[0])))
    finally:
        file.close()


def _decoded(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, path, place, size in zip(*(batch.column(c).to_pylist() for c in ("base", "path", "place", "size"))):
                ids, tokens = read_block(path, place, size)
                lengths = np.array([len(t) for t in tokens], np.int64)
                raw = [t.astype("<u4").tobytes() for t in tokens]
                columns = [pa.array(ids, pa.int64()), pa.array(base + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []), names=["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
    return run


def read(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` (and ``ids``, 32-bit little endian) of every document, from the files."""
    sums = index.groupBy("part").agg(F.sum("tokens").alias("total"))  # a row per range of the sort
    parts = sums.select(F.col("part").alias("b_part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    blocks = index.withColumn("within", within).join(parts, F.col("part") == F.col("b_part")).select(
        "part", "number", "path", "place", "size", (F.col("before") + F.col("within")).alias("base"))
    tasks = max(1, -(-index.count() // READ_BLOCKS))
    return blocks.repartitionByRange(tasks, "part", "number").mapInArrow(_decoded(with_ids), DOCS + (", ids binary" if with_ids else ""))
