"""Ranked lexical search over an index of per-term geometric blocks.

The documents are cut into slices; every slice is indexed and searched on its own, so no posting is shuffled.

1. **Statistics.** One pass counts documents, terms and, for the terms of the queries, the documents that hold each. Only counts leave a task.
2. **Index.** In a slice every query term has a posting list. A list is cut into blocks of about ``BLOCK`` documents that are *alike*: documents are
   sketched by a random projection of their weighted terms, and each goes to the nearest of some representatives of the list. A block stores its *summary*: the
   coordinatewise maximum of its documents' term values. As documents with a heavier term of the query were met in that term's list, a summary needs the terms of
   its own weight and below only, and of those only what some query uses together with the list's term. The index is a table in the shared folder.
3. **Search.** A query visits the lists of its terms, heaviest first. A block's summary times the query's weights is an exact upper bound of the score of any of its documents not met
   before; the block is skipped only if that bound is below the ``k``-th best score so far. Documents of the other blocks are scored exactly.
   Beyond ``COORDINATES`` terms of a query the bound takes the greatest value of the slice instead: still a bound, only less tight.
4. **Threshold.** One slice in ``FIRST`` is searched before all others. The ``k``-th best score found there is one that no result can be below, so
   with it all slices skip most blocks and hand on few rows. The best of all slices are merged in two steps.

Queries are broadcast in blocks of about ``QUERY_BYTES``; more queries are more passes over the documents.

Scores are whole numbers as in the contract of ``search``. Defined cases: null and empty texts have no terms, so they are not counted, found or looked for; every row
is a document, repeated rows take a rank each; of equal scores the smaller id comes first, null ids last; a query that holds a term twice counts it once; items of equal id and text are one; a null
item id is an item; empty tables give an empty result; a very long text is one slice of its own, a very long query a block of its own. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from twinweave.llm.words import WORD_BYTES, slices, words_of
from twinweave.session import durable

#: Documents of a block, about.
BLOCK = 64
#: Terms of a query whose maxima a summary holds, from the list's own term on.
COORDINATES = 64
#: One slice in so many is searched first.
FIRST = 16
QUERY_BYTES = 1 << 18
#: Documents times query terms of a slice: its values are a matrix of 4 bytes each.
MATRIX = 1 << 24
SLICE = 8 << 20
_SKETCH = 16
_UNIT = 10 ** 9


def lengths_in(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``m`` of documents with ``n`` terms each: 10 and 90 times their length over the mean length, rounded down."""
    if len(n) and 90 * documents * int(n.max()) >= 1 << 62:
        return np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)
    return 10 + 90 * n * documents // max(1, terms)


def value_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _UNIT * tf // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Queries:
    """A block of queries: terms are numbered by falling weight, a query is its terms in that order."""

    names: list[tuple[int, int]]
    hashes: np.ndarray  # of the terms, sorted
    number: np.ndarray  # term number of each of these
    weights: np.ndarray  # by term number
    terms: list[np.ndarray]
    documents: int
    total: int
    k: int
    block: int = BLOCK
    coordinates: int = COORDINATES
    matrix: int = MATRIX
    beside: dict[int, np.ndarray] = field(default_factory=dict)  # per term: the coordinates of its summaries
    columns: list[list[np.ndarray]] = field(default_factory=list)  # per query and term: where its terms lie among these
    least: np.ndarray | None = None  # per query: a score that no result is below

    @classmethod
    def of(cls, names, hashes: np.ndarray, queries: list[np.ndarray], df: np.ndarray, documents: int, total: int, k: int,
           block: int = BLOCK, coordinates: int = COORDINATES, matrix: int = MATRIX) -> Queries:
        heavy = np.array([weight(int(n), documents) for n in df], np.int64)
        order = np.lexsort((hashes, -heavy))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        terms = [np.sort(number[np.searchsorted(hashes, q)]) for q in queries]
        made = cls(names, hashes, number, heavy[order], terms, documents, total, k, block, coordinates, matrix)
        wanted: dict[int, list[np.ndarray]] = {}
        for q in terms:
            for i, t in enumerate(q.tolist()):
                wanted.setdefault(t, []).append(q[i:i + coordinates])
        made.beside = {t: np.unique(np.concatenate(some)) for t, some in wanted.items()}
        made.columns = [[np.searchsorted(made.beside[t], q[i:i + coordinates]) for i, t in enumerate(q.tolist())] for q in terms]
        made.least = np.ones(len(terms), np.int64)
        return made

    def postings(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term number and occurrences of the query terms in each text, in that order."""
        at, found = _looked_up(self.hashes, words.hashes())
        keys = words.row_of()[found] * len(self.hashes) + self.number[at[found]]
        keys, tf = np.unique(keys, return_counts=True)
        return keys // len(self.hashes), keys % len(self.hashes), tf


def _looked_up(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return at, np.flatnonzero(sorted_hashes[at] == hashes)


def _counted(shared):
    """Documents that hold each term; documents with a term at -1, all terms at -2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: np.ndarray = shared.value
        df, documents, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for part in slices(batches, size=SLICE):
            words = words_of(part.column("text"), WORD_BYTES, lower=True)
            documents += int((words.counts > 0).sum())
            total += len(words.starts)
            at, found = _looked_up(vocabulary, words.hashes())
            keys = np.unique(words.row_of()[found] * len(vocabulary) + at[found])
            df += np.bincount(keys % len(vocabulary), minlength=len(vocabulary))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], held])), pa.array(np.concatenate([[documents, total], df[held]]))], names=["term", "n"])
    return run


def blocked(sketch: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of ``sketch`` that puts alike ones together, and where each block begins."""
    n = len(sketch)
    if n <= size:
        return np.arange(n), np.zeros(1, np.int64)
    chosen = np.linspace(0, n - 1, -(-n // size)).astype(np.int64)
    nearest = (sketch @ sketch[chosen].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    nearest = nearest[order]
    return order, np.flatnonzero(np.concatenate([[True], nearest[1:] != nearest[:-1]]))


_INDEX = "ids array<long>, row binary, term binary, value binary, list binary, docs binary, starts binary, summaries binary"


def _matrix(row: np.ndarray, term: np.ndarray, value: np.ndarray, documents: int, terms: int) -> np.ndarray:
    out = np.zeros((documents, terms), np.int32)
    out[row, term] = value
    return out


def _indexed(shared):
    """One row per slice: its documents' values, and per list the documents block by block, where blocks begin, and their summaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        terms = len(queries.hashes)
        project = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (terms, _SKETCH))
        most = max(1, queries.matrix // terms)
        for piece in slices(batches, size=SLICE):
            for at in range(0, piece.num_rows, most):
                part = piece.slice(at, most)
                words = words_of(part.column("text"), WORD_BYTES, lower=True)
                row, term, tf = queries.postings(words)
                if not len(row):
                    continue
                value = value_of(tf, lengths_in(words.counts, queries.documents, queries.total)[row])
                matrix = _matrix(row, term, value, part.num_rows, terms)
                sketch = (matrix * queries.weights.astype(np.float32)) @ project
                sketch /= np.maximum(1e-9, np.sqrt((sketch * sketch).sum(axis=1, keepdims=True)))
                by_term = np.argsort(term, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], term[by_term][1:] != term[by_term][:-1]]))
                lists, docs, starts, summaries = [], [], [], []
                for low, high in zip(first.tolist(), [*first[1:].tolist(), len(by_term)]):
                    t, members = int(term[by_term[low]]), row[by_term[low:high]]
                    order, begin = blocked(sketch[members], queries.block)
                    members = members[order]
                    summary = np.maximum.reduceat(matrix[members[:, None], queries.beside[t]], begin, axis=0)
                    lists.append((t, len(members), len(begin)))
                    docs.append(members)
                    starts.append(begin)
                    summaries.append(summary.ravel())
                cells = [row, term, value, np.array(lists), np.concatenate(docs), np.concatenate(starts), np.concatenate(summaries)]
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), *[pa.array([c.astype("<i4").tobytes()], pa.binary()) for c in cells]],
                                                 names=["ids", "row", "term", "value", "list", "docs", "starts", "summaries"])
    return run


class Slice:
    """A slice of the index, opened."""

    def __init__(self, row: dict, queries: Queries):
        read = lambda name: np.frombuffer(row[name], "<i4").astype(np.int64)
        ids = row["ids"]
        self.no_id = np.array([i is None for i in ids])
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.values = _matrix(read("row"), read("term"), read("value"), len(ids), len(queries.hashes))
        self.top = self.values.max(axis=0).astype(np.int64)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        docs, starts, summaries = read("docs"), read("starts"), np.frombuffer(row["summaries"], "<i4")
        d = s = m = 0
        for t, n, blocks in read("list").reshape(-1, 3).tolist():
            width = len(queries.beside[t])
            self.lists[t] = docs[d:d + n], np.append(starts[s:s + blocks], n), summaries[m:m + blocks * width].reshape(blocks, width)
            d, s, m = d + n, s + blocks, m + blocks * width


@dataclass
class Best:
    """The best ``k`` so far: scores, ids, whether the id is null."""

    k: int
    least: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    none: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least
        score, doc, none = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score))[:self.k]
        self.score, self.doc, self.none = score[order], doc[order], none[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def search_slice(part: Slice, queries: Queries, q: int, best: Best) -> tuple[int, int]:
    """Bring ``best`` up to date with one slice; how many blocks were scored and skipped."""
    terms = queries.terms[q]
    weights = queries.weights[terms]
    after = np.append(np.cumsum((weights * part.top[terms])[::-1])[::-1], 0)  # what the terms from here on can add up to
    met = np.zeros(len(part.ids), bool)
    scored = skipped = 0
    for i, t in enumerate(terms.tolist()):
        if after[i] < best.least:
            break  # nothing that holds only these terms can be among the best
        if t not in part.lists:
            continue
        docs, starts, summary = part.lists[t]
        near = i + queries.coordinates
        bound = summary[:, queries.columns[q][i]].astype(np.int64) @ weights[i:near] + after[min(near, len(terms))]
        open_ = np.flatnonzero(bound >= best.least)
        scored, skipped = scored + len(open_), skipped + len(bound) - len(open_)
        if not open_.size:
            continue
        chosen = np.zeros(len(docs) + 1, np.int64)
        np.add.at(chosen, starts[open_], 1)
        np.add.at(chosen, starts[open_ + 1], -1)
        found = docs[np.cumsum(chosen[:-1]) > 0]
        found = found[~met[found]]
        met[found] = True
        best.add(part.values[found[:, None], terms].astype(np.int64) @ weights, part.ids[found], part.no_id[found])
    return scored, skipped


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best = [Best(queries.k, int(x)) for x in queries.least]
        for batch in batches:
            for r in range(batch.num_rows):
                part = Slice(batch.slice(r, 1).to_pylist()[0], queries)
                for q in range(len(best)):
                    search_slice(part, queries, q, best[q])
        sizes = [len(b.score) for b in best]
        names = np.repeat(np.array(queries.names, np.int64).reshape(-1, 2), sizes, axis=0)
        joined = lambda get, kind: np.concatenate([get(b) for b in best] or [np.zeros(0, kind)])
        yield pa.RecordBatch.from_arrays([
            pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(joined(lambda b: b.doc, np.int64), mask=joined(lambda b: b.none, bool).astype(bool)),
            pa.array(joined(lambda b: b.score, np.int64))], names=["h1", "h2", "doc", "score"])
    return run


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, first of parts of a query's rows."""
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    part = F.row_number().over(W.partitionBy("h1", "h2", "part").orderBy(*order))
    whole = F.row_number().over(W.partitionBy("h1", "h2").orderBy(*order))
    some = found.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(64))).withColumn("rank", part).where(F.col("rank") <= k)
    return some.withColumn("rank", whole).where(F.col("rank") <= k).select("h1", "h2", "rank", "doc", "score")


def _searched_block(rows: DataFrame, texts: pa.Table, k: int, first: int, **options: int) -> DataFrame | None:
    """``h1, h2, rank, doc, score`` of one block of queries; None if there is nothing to look for."""
    context = rows.sparkSession.sparkContext
    column = texts.column("text").combine_chunks()
    words = words_of(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, WORD_BYTES, lower=True)
    hashes = words.hashes()
    held = [np.unique(hashes[a:b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    names = list(zip(texts.column("h1").to_pylist(), texts.column("h2").to_pylist()))
    names, held = [n for n, h in zip(names, held) if len(h)], [h for h in held if len(h)]
    if not held:
        return None
    vocabulary = np.unique(np.concatenate(held))
    counts = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_counted(context.broadcast(vocabulary)), "term long, n long")
              .groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per query term
    documents, total = counts.get(-1, 0), counts.get(-2, 0)
    if not documents:
        return None
    df = np.array([counts.get(t, 0) for t in range(len(vocabulary))])
    queries = Queries.of(names, vocabulary, held, df, documents, total, k, **options)
    index = durable(rows.mapInArrow(_indexed(context.broadcast(queries)), _INDEX))
    kind = "h1 long, h2 long, doc long, score long"
    early = index.where(F.pmod(F.xxhash64("ids"), F.lit(first)) == 0).mapInArrow(_searched(context.broadcast(queries)), kind)
    sure = {(r["h1"], r["h2"]): r["score"] for r in _best_rows(early, k).where(F.col("rank") == k).collect()}  # a row per query
    queries.least = np.array([max(1, sure.get(n, 1)) for n in names], np.int64)
    return _best_rows(index.mapInArrow(_searched(context.broadcast(queries)), kind), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", *,
           query_bytes: int = QUERY_BYTES, block: int = BLOCK, coordinates: int = COORDINATES, matrix: int = MATRIX, first: int = FIRST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, of those with a score above 0.

    A term of ``df`` of ``N`` documents weighs ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a document's score adds up the weights of the item's terms, each times
    ``10^9 tf div (1000 tf + 8 m)`` with ``m = 10 + 90 n N div L``: ``tf`` is how often it holds the term, ``n`` how many terms it holds in all, ``L`` those of all documents.
    """
    if min(k, query_bytes, block, coordinates, matrix, first) < 1:
        raise ValueError("all parameters must be positive")
    named = durable(items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h1"),
                                                                F.xxhash64(F.lit("second"), text).alias("h2")).distinct())
    texts = durable(named.select("text", "h1", "h2").distinct())
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    blocks, found = -(-int(size) // query_bytes), []
    for b in range(blocks):
        best = _searched_block(rows, texts.where(F.pmod("h1", F.lit(blocks)) == b).orderBy("h1", "h2").toArrow(), k, first, block=block, coordinates=coordinates, matrix=matrix)
        if best is not None:
            found.append(durable(best) if blocks > 1 else best)
    if not found:
        return named.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    owners = named.select("item_id", F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    return every.join(owners, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2"))).select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
