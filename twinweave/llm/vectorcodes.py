"""Vector code compression: product codes whose rounds are pruned by norm-of-sum bounds.

A vector's components become whole numbers, ``floor(256 * x)``, and the vector is cut into equal parts. Each part position has a codebook of up to
``entries`` entries; ``rounds`` times every part is assigned to its nearest entry and every entry is replaced by the floored mean of its parts.

1. **First assignment**: all distances. Per part the nearest entry is kept, and per group of ``GROUP`` neighbouring entries a lower bound: the distance
   to the nearest entry of the group that is not the assigned one, with the number of the round it was measured in, its *stamp*.
2. **Later rounds** keep the history of all codebooks. An entry that was at ``C_T`` when a bound was stamped and is at ``C_t`` now cannot have come nearer
   than its net displacement ``|C_t - C_T|``. That is one norm of the summed moves, never more than the sum of the norms of the single moves that
   drifting bounds add up. A group is left out if its bound less the largest net displacement of its entries exceeds the
   exact distance to the assigned entry; only what remains is measured again, and gets the present stamp.
3. **Means**: every task adds up the parts per entry, Spark adds up the tasks; what the driver sees is one codebook, whatever the number of rows.

Distances are 64-bit integers; bounds are rounded towards the safe side, so the codes are those of a full search. Each round's state is a table in the
shared folder: a lost executor repeats its tasks of one round.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped. The length of a vector is that of the kept
row of the least id; kept rows of another length, and all if that length is no positive multiple of ``parts``, have a null code and error. Null ids come
after all others; equal ids are ordered by their components. Fewer rows than ``entries`` make a smaller codebook. Ties of distance go to the lower index.
Repeated rows get equal codes and count as often as they are there. An empty table gives an empty result. Components so large that a squared distance needs
more than 63 bits are an overflow error, as in SQL. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from twinweave.operators.skew import salted_lookup
from twinweave.session import durable

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Neighbouring entries that share a bound.
GROUP = 8
#: Rows whose distances are held at a time: 8,192 x 64 of 8 bytes are 4 MB.
STEP = 1 << 13
_FAR = np.iinfo(np.int64).max
#: Bounds are cut by this share when stored in 32 bits and raised by it when compared: far more than rounding can do.
_SLACK = 1e-6


@dataclass
class Codebooks:
    """The history: ``books[t]`` is ``parts x entries x width`` after ``t`` rounds."""

    books: list[np.ndarray]

    @property
    def parts(self) -> int:
        return self.books[0].shape[0]

    @property
    def entries(self) -> int:
        return self.books[0].shape[1]

    @property
    def width(self) -> int:
        return self.books[0].shape[2]

    @property
    def groups(self) -> int:
        return -(-self.entries // GROUP)

    def moved(self) -> np.ndarray:
        """Per part, earlier round and group: the largest net displacement of an entry since then, rounded up."""
        now = self.books[-1].astype(np.float64)
        out = np.zeros((self.parts, len(self.books), self.groups))
        for t, book in enumerate(self.books):
            net = np.sqrt(((now - book.astype(np.float64)) ** 2).sum(axis=2)) * (1 + _SLACK)
            for g in range(self.groups):
                out[:, t, g] = net[:, g * GROUP:(g + 1) * GROUP].max(axis=1)
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books[-1].ravel().tolist())).encode()).hexdigest()


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all ``entries``."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        gap = x[:, d, None] - entries[None, :, d]
        out += gap * gap
    return out


def _bounds(near: np.ndarray, code: np.ndarray, groups: int) -> np.ndarray:
    """Distance to the nearest entry of each group but the assigned one, rounded down."""
    others = near.astype(np.float64)
    others[near == _FAR] = np.inf
    others[np.arange(len(code)), code] = np.inf
    padded = np.full((len(code), groups * GROUP), np.inf)
    padded[:, :others.shape[1]] = others
    return (np.sqrt(padded.reshape(len(code), groups, GROUP).min(axis=2)) * (1 - _SLACK)).astype(np.float32)


def first_assignment(x: np.ndarray, books: Codebooks, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and bounds of each row by a full search."""
    near = _squared(x, books.books[-1][part])
    code = near.argmin(axis=1)
    return code, _bounds(near, code, books.groups)


def next_assignment(x: np.ndarray, books: Codebooks, part: int, moved: np.ndarray, code: np.ndarray, low: np.ndarray, stamp: np.ndarray):
    """Code, bounds, stamps and the number of groups measured, by the bounds of earlier rounds."""
    book, rows = books.books[-1][part], np.arange(len(x))
    gap = x - book[code]
    own = (gap * gap).sum(axis=1)
    net = moved[part][stamp, np.arange(books.groups)[None, :]]
    open_ = low - net <= (np.sqrt(own.astype(np.float64)) * (1 + _SLACK))[:, None]
    near = np.full((len(x), books.entries), _FAR)
    near[rows, code] = own

    def measure(which: np.ndarray) -> None:
        for g in range(books.groups):
            r = np.flatnonzero(which[:, g])
            if r.size:
                near[r, g * GROUP:(g + 1) * GROUP] = _squared(x[r], book[g * GROUP:(g + 1) * GROUP])

    measure(open_)
    new = near.argmin(axis=1)
    # a bound does not cover the entry that was assigned: where that changed, its group is measured as well
    left = np.zeros_like(open_)
    gone = np.flatnonzero((new != code) & ~open_[rows, code // GROUP])
    left[gone, code[gone] // GROUP] = True
    measure(left)
    open_ |= left
    fresh = _bounds(near, new, books.groups)
    return new, np.where(open_, fresh, low), np.where(open_, np.uint8(len(books.books) - 1), stamp), open_.sum(axis=1)


_KEPT = "id long, label string, x binary"
_STATE = _KEPT + ", code binary, low binary, stamp binary, measured int"


def _ints(column: pa.Array, width: int) -> np.ndarray:
    """Whole vectors of ``width`` numbers of four bytes each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<i4").reshape(len(column), width).astype(np.int64)


def _rows(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _cells(values: np.ndarray, kind: str) -> pa.Array:
    flat = np.ascontiguousarray(values.reshape(len(values), -1).astype(kind))
    size = flat.shape[1] * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer((np.arange(len(flat) + 1) * size).astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _check(values: np.ndarray, limit: int) -> None:
    if values.size and np.abs(values).max() > limit:
        raise OverflowError(f"a component is beyond {limit}: squared distances do not fit a long")


def _packed(limit: int):
    """Whole numbers as four bytes each; ``limit`` is the largest component that keeps squared distances below 2^63."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            _check(values, limit)
            whole = np.floor(values * SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _cells(whole.reshape(batch.num_rows, -1), "<i4")], names=["id", "label", "x"])
    return run


def _assigned(shared):
    """One assignment; the first has no state yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        parts, groups, width = books.parts, books.groups, books.width
        moved = books.moved()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows = batch.slice(at, STEP)
                n = rows.num_rows
                x = _ints(rows.column("x"), parts * width).reshape(n, parts, width)
                first = "code" not in rows.schema.names
                code = np.zeros((n, parts), np.int64) if first else _rows(rows.column("code"), "u1", parts).astype(np.int64)
                low = np.zeros((n, parts, groups), np.float32) if first else _rows(rows.column("low"), "<f4", parts, groups).copy()
                stamp = np.zeros((n, parts, groups), np.uint8) if first else _rows(rows.column("stamp"), "u1", parts, groups).copy()
                measured = np.full(n, parts * groups) if first else rows.column("measured").to_numpy().astype(np.int64)
                for p in range(parts):
                    if first:
                        code[:, p], low[:, p] = first_assignment(x[:, p], books, p)
                    else:
                        code[:, p], low[:, p], stamp[:, p], more = next_assignment(x[:, p], books, p, moved, code[:, p], low[:, p], stamp[:, p])
                        measured = measured + more
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), rows.column("label"), rows.column("x"), _cells(code, "u1"), _cells(low, "<f4"), _cells(stamp, "u1"), pa.array(measured, pa.int32())],
                    names=["id", "label", "x", "code", "low", "stamp", "measured"])
    return run


def _added(parts: int, entries: int, width: int):
    """Sums of the parts of each entry, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows = batch.slice(at, STEP)
                x = _ints(rows.column("x"), parts * width).reshape(-1, parts, width)
                code = _rows(rows.column("code"), "u1", parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(v, width), pa.int64()) for v in (p, e)] + [pa.array(np.tile(np.arange(width), len(p)), pa.int64()),
            pa.array(total[p, e].ravel(), pa.int64()), pa.array(np.repeat(count[p, e], width), pa.int64())], names=["part", "entry", "place", "total", "n"])
    return run


def _errors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        for batch in batches:
            code = _rows(batch.column("code"), "u1", books.parts).astype(np.int64)
            x = _ints(batch.column("x"), books.parts * books.width).reshape(-1, books.parts, books.width)
            gap = x - books.books[-1][np.arange(books.parts)[None, :], code]
            error = (gap * gap).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.hex() for c in batch.column("code").to_pylist()], pa.string()),
                                              pa.array(error, pa.int64()), batch.column("measured")], names=["id", "label", "code", "error", "measured"])
    return run


def _improved(state: DataFrame, books: Codebooks) -> np.ndarray:
    """The codebook of the next round: floored means; entries without a part stay."""
    sums = state.select("x", "code").mapInArrow(_added(books.parts, books.entries, books.width), "part long, entry long, place long, total long, n long")
    rows = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    new = books.books[-1].copy()
    for r in rows:
        new[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding",
             label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """``id, label, code, error, measured`` of every kept vector, and the codebooks of all rounds (None without a vector to code).

    ``code`` has two hex digits per part, ``error`` is the squared distance to what the code stands for, ``measured`` how many groups of entries
    were compared in all (``parts * groups`` by the first assignment). ``label`` is text here.
    """
    if parts < 1 or not 1 <= entries <= 256 or not 0 <= rounds < 255:
        raise ValueError("there are 1 to 256 entries, 0 to 254 rounds and at least one part")
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).collect()
    size = len(first[0]["v"]) if first else 0
    width = size // parts
    none = "id long, label string, code string, error long, measured int"
    if not size or size % parts:
        return rows.select("id", "label", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("measured", "int"))]), None
    fitting = rows.where(F.size("v") == size)
    start = [r["v"] for r in fitting.orderBy(*order).limit(entries).collect()]  # a codebook: at most `entries` rows
    limit = int((2 ** 61 / size) ** .5 / SCALE)
    _check(np.array(start), limit)
    book = np.floor(np.array(start) * SCALE).astype(np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    books = Codebooks([np.ascontiguousarray(book)])

    context = vectors.sparkSession.sparkContext
    state = fitting.mapInArrow(_packed(limit), _KEPT)
    for t in range(rounds + 1):
        state = state.mapInArrow(_assigned(context.broadcast(books)), _STATE)
        if t < rounds:
            state = durable(state)
            books = Codebooks([*books.books, _improved(state, books)])
    coded = state.mapInArrow(_errors(context.broadcast(books)), none)
    other = rows.where(F.size("v") != size).select("id", "label", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("measured", "int"))])
    return coded.unionByName(other), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of equal label added up, null labels together.

    A label that holds a large part of the rows is split.
    """
    keyed = durable(coded).withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(""))})
    sums = durable(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("load")))
    load = sums.select("_none", "_label", F.col("load").cast("double").alias("load"))
    found = salted_lookup(keyed, sums.select("_none", "_label", "label_error"), ["_none", "_label"], [F.col("id"), F.col("code"), F.col("error")], load)
    return found.select(*coded.columns, "label_error")
