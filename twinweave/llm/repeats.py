"""Substring deduplication by prefix-partitioned suffix trees.

A window of ``size`` words is a repeat if the same words also start earlier: in a document of smaller id, or earlier in
the same document. All words covered by repeats are removed; windows are judged on the input.

1. **Suffixes.** Of all suffixes of a document only a sample is followed, chosen by content: in every window, that whose first
   ``prefix`` words have the least hash (the leftmost of equals). Equal windows choose at the same place, so a repeat of
   ``size`` words always contains a followed suffix at the same distance; of windows of 20 words about two suffixes in seventeen are followed.
2. **Prefixes.** Suffixes are counted by their first ``prefix`` words (a partial aggregate). A prefix that one place of one text has
   alone cannot repeat and is dropped. A prefix with up to ``group_rows`` suffixes makes one group, which fits in memory.
   A prefix with more is lengthened to all that its windows reach, then to single windows: each is a leaf with one word sequence, of which
   only the least place is needed. That is again a partial aggregate, however many rows a leaf has.
3. **Trees.** A group's suffixes, sorted by Spark, and the lengths that neighbours share are its suffix tree: rows
   between two shared lengths below ``d`` hang under one node of depth ``d`` or more. A window that starts ``t`` words before
   the suffix is shared under a node of depth ``size - t`` by rows that also have their last ``t`` words before it in common.
4. Ranges of removed windows go back to their documents.

Exact copies are recognised by their whole text: prefixes that only copies share are dropped in step 2, and every copy but the first
loses all its windows. Words are compared by hash: 64 bits for a prefix and for each further word, 128 for a whole window.

Defined cases: null text has no words; documents of fewer than ``size`` words keep all; rows of equal id are one document (their equal
places are not earlier than each other); a null id counts as the largest there is; repeated rows get equal results and are listed once, so
no list grows with the rows of an id.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from twinweave.llm.words import NOT_SPACE, Words, mixed, rolled, slices, words_of

#: Suffixes in a group whose tree is made in memory: about 500 bytes each, 32 MB in all.
GROUP_ROWS = 1 << 16
_NO_ID = (1 << 63) - 1
_WHOLE = (1 << 62)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each ``width`` neighbours (as many places as full windows)."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        n = max(0, len(best) - step)
        right = best[step:step + n] < best[:n]
        at = np.where(right, at[step:step + n], at[:n])
        best = np.where(right, best[step:step + n], best[:n])
        span += step
    return at


def _followed(words: Words, size: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Word hashes, prefix hashes, and per followed suffix: its place and the first and last window start it stands for."""
    hashes = words.hashes()
    keys = rolled(hashes, prefix)
    starts = words.window_starts(size)
    if not starts.size:
        none = np.empty(0, np.int64)
        return hashes, keys, none, none, none
    at = least_places(keys, size - prefix + 1)[starts]
    row = words.row_of()[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return hashes, keys, at[first], starts[first], starts[last]


def _suffixes(size: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column("text"), NOT_SPACE)
            _, keys, at, _, _ = _followed(words, size, prefix)
            row = words.row_of()[at]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[at].view(np.int64)), part.column("doc_key").take(pa.array(row)), pa.array(at - words.first[row])],
                names=["key", "doc_key", "at"])
    return run


def _counted(size: int, prefix: int):
    """One row per document and prefix: how often, and the least and greatest mark of the texts it is in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column("text"), NOT_SPACE)
            _, keys, at, _, _ = _followed(words, size, prefix)
            row, keys = words.row_of()[at], keys[at]
            order = np.lexsort((keys, row))
            row, keys = row[order], keys[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(row)))
            mark = part.column("text_key").to_numpy()[row[first]]
            other = np.where(n > 1, mark ^ 1, mark)  # two places of one text count as two texts
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[first].view(np.int64)), pa.array(np.minimum(mark, other)), pa.array(np.maximum(mark, other)), pa.array(n, pa.int64())],
                names=["key", "low", "high", "n"])
    return run


def _flags(lists: pa.Array, words: Words, at: np.ndarray) -> np.ndarray:
    """Which of the suffixes at ``at`` are listed by their document (word numbers in a list per row)."""
    wanted = np.zeros(len(words.starts), bool)
    sizes = np.diff(lists.offsets.to_numpy())
    base, most = np.repeat(words.first[:-1], sizes), np.repeat(words.counts, sizes)
    places = lists.flatten().to_numpy()
    inside = places < most
    wanted[(base + places)[inside]] = True
    return wanted[at]


def _segments(size: int, prefix: int):
    """Rows of listed suffixes, with the words before (nearest first) and after the prefix that their windows reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(_opened(batches)):
            words = words_of(part.column("text"), NOT_SPACE)
            hashes, keys, at, lo, hi = _followed(words, size, prefix)
            listed = _flags(part.column("places"), words, at)
            at, lo, hi = at[listed], lo[listed], hi[listed]
            whole = hashes.astype(">u8")
            row = words.row_of()[at]
            ahead = hi + size - at - prefix
            behind = at - lo
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[at].view(np.int64)), part.column("id").take(pa.array(row)), part.column("text_key").take(pa.array(row)),
                pa.array((at - words.first[row]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)),
                _binary(whole, at + prefix, ahead, 1), _binary(whole, at - 1, behind, -1)],
                names=["key", "id", "text_key", "at", "more", "ahead", "behind"])
    return run


def _binary(values: np.ndarray, start: np.ndarray, count: np.ndarray, step: int) -> pa.Array:
    """A binary value per row: ``count`` of the values from ``start`` on."""
    ends = np.cumsum(count)
    inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
    data = values[np.repeat(start, count) + step * inner] if len(inner) else values[:0]
    offsets = np.concatenate([[0], 8 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Words of each row, filled up with zeros; a value beyond a row's end is never compared by equal windows."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) // 8
    values = np.frombuffer(data, ">u8").astype(np.uint64) if data is not None and data.size else np.zeros(0, np.uint64)
    count = np.diff(at)
    out = np.zeros((len(column), width), np.uint64)
    rows = np.repeat(np.arange(len(column)), count)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    out[rows, inner] = values[np.repeat(at[:-1], count) + inner]
    return out


def _repeats(group: pa.Table, size: int, prefix: int) -> pa.RecordBatch:
    """Ranges of windows that have an earlier equal, of whole groups sorted by key and words ahead."""
    column = lambda name: group.column(name).combine_chunks()
    span = size - prefix
    key, ids, at, more = (column(c).to_numpy() for c in ("key", "id", "at", "more"))
    ahead, behind = _matrix(column("ahead"), span), _matrix(column("behind"), span)
    n = len(key)
    far = pc.binary_length(column("behind")).to_numpy() // 8
    near = far - more
    shared = np.full(n, -1)  # words that a suffix shares with the one before it
    if n > 1:
        same = np.logical_and.accumulate(ahead[1:] == ahead[:-1], axis=1).sum(axis=1)
        shared[1:] = np.where(key[1:] == key[:-1], prefix + same, -1)
    late = np.zeros((n, span + 1), bool)
    left = np.zeros(n, np.uint64)
    for t in range(span + 1):
        if t:
            left = mixed(left * np.uint64(0x9E3779B97F4A7C15) + behind[:, t - 1] + np.uint64(1))
        node = np.cumsum(shared < size - t)
        rows = np.flatnonzero((near <= t) & (t <= far))
        if len(rows) < 2:
            continue
        rows = rows[np.bincount(node[rows], minlength=n + 1)[node[rows]] > 1]  # leaves have no repeat
        if len(rows) < 2:
            continue
        rows = rows[np.lexsort((at[rows], ids[rows], left[rows], node[rows]))]
        new = np.ones(len(rows), bool)
        new[1:] = (node[rows[1:]] != node[rows[:-1]]) | (left[rows[1:]] != left[rows[:-1]])
        head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        late[rows, t] = (ids[rows] != ids[head]) | (at[rows] != at[head])
    # runs of neighbouring window starts: t falls as the start grows
    edge = np.zeros((n, span + 3), np.int8)
    edge[:, 1:-1] = late
    step = np.diff(edge, axis=1)
    r, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays([
        pa.array(ids[r]), column("text_key").take(pa.array(r)), pa.array((at[r] - (high - 1)).astype(np.int64)), pa.array((at[r] - low).astype(np.int64))],
        names=["id", "text_key", "first", "last"])


def _trees(size: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            # all groups before the last one of this batch are complete
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if held and (cut or held[-1].column("key")[-1].as_py() != keys[0]):
                yield _repeats(pa.Table.from_batches([*held, batch.slice(0, cut)]), size, prefix)
                held = []
            elif cut:
                yield _repeats(pa.Table.from_batches([batch.slice(0, cut)]), size, prefix)
            held.append(batch.slice(cut))
            rows += batch.num_rows
        if held:
            yield _repeats(pa.Table.from_batches(held), size, prefix)
    return run


def _windows(size: int, prefix: int):
    """Rows of listed suffixes with the hashes of all windows they stand for: the longest prefixes there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(_opened(batches)):
            words = words_of(part.column("text"), NOT_SPACE)
            hashes, _, at, lo, hi = _followed(words, size, prefix)
            listed = _flags(part.column("places"), words, at)
            at, lo, count = at[listed], lo[listed], (hi - lo + 1)[listed]
            ends = np.cumsum(count)
            starts = np.repeat(lo - ends + count, count) + np.arange(int(count.sum()))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(rolled(h, size)[starts].view(np.int64))) for h in (hashes, mixed(hashes))]
            row = words.row_of()[at]
            yield pa.RecordBatch.from_arrays([
                part.column("id").take(pa.array(row)), part.column("text_key").take(pa.array(row)), pa.array(lo - words.first[row]), *lists],
                names=["id", "text_key", "start", "w1", "w2"])
    return run


def _kept(size: int, verbatim: bool, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(_opened(batches)):
            words = words_of(part.column("text"), NOT_SPACE)
            counts = words.counts
            cover = np.zeros(len(words.starts) + 1, np.int64)
            lists = part.column("ranges")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            base, most = np.repeat(words.first[:-1], sizes), np.repeat(counts, sizes)
            first, last = (values.field(c).to_numpy() for c in ("first", "last"))
            last = np.minimum(last, most - size)
            sound = first <= last
            np.add.at(cover, (base + first)[sound], 1)
            np.add.at(cover, (base + last + size)[sound], -1)
            gone = np.cumsum(cover)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[words.first[1:]] - total[words.first[:-1]]
            texts = []
            for r in range(part.num_rows):
                a, b = words.first[r], words.first[r + 1]
                raw = words.data[words.offsets[r]:words.offsets[r + 1]].tobytes()
                if removed[r]:
                    own, base_at = ~gone[a:b], words.offsets[r]
                    texts.append(b" ".join(raw[s:e] for s, e in zip((words.starts[a:b][own] - base_at).tolist(), (words.ends[a:b][own] - base_at).tolist())))
                else:
                    texts.append(raw if verbatim else b" ".join(raw.split()))
            out = pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("none"), part.column("text_key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), out,
                                              *[part.column(f"c_{k}") for k in range(carried)]],
                                             names=["id", "none", "text_key", "n_words", "n_removed", "kept", *[f"c_{k}" for k in range(carried)]])
    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def _doc_key() -> Column:
    """What texts are dealt by: id and text, so that a null or repeated id is no hot key. It only deals; where two documents share
    a key by chance, their ids and texts still tell them apart."""
    return F.xxhash64("id", "text_key")


def _whole_rows(docs: DataFrame, doc_id: str, text: str, carry: list[str]) -> DataFrame:
    """Rows with text and carried columns as one struct: whatever reads it shuffles the same columns, and the exchange is reused."""
    named = [F.col(text).alias("text"), F.col(doc_id).isNull().alias("none"), *[F.col(c).alias(f"c_{k}") for k, c in enumerate(carry)]]
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("text_key"), F.struct(*named).alias("doc"))
    return rows.select(_doc_key().alias("doc_key"), "*")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the fields of ``doc`` in its place."""
    for batch in batches:
        at = batch.schema.get_field_index("doc")
        doc = batch.column(at)
        columns = [c for k, c in enumerate(batch.columns) if k != at] + doc.flatten()
        names = [n for k, n in enumerate(batch.schema.names) if k != at] + [f.name for f in doc.type]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def repeated_ranges(docs: DataFrame, size: int = 20, doc_id: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS, carry: list[str] | None = None) -> DataFrame:
    """``id, text_key, first, last``: starts ``first..last`` (word numbers) of windows that also start earlier."""
    if size < 2:
        raise ValueError("a window has at least two words")
    prefix = max(1, size // 4)
    rows = _rows(docs, doc_id, text)
    counts = rows.mapInArrow(_counted(size, prefix), "key long, low long, high long, n long").groupBy("key").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    again = counts.where("low <> high").select(_anew("key").alias("again"), (F.col("n") > group_rows).alias("wide"))
    dealt = rows.select(_doc_key().alias("doc_key"), "text")
    places = dealt.mapInArrow(_suffixes(size, prefix), "key long, doc_key long, at long").join(again, _anew("key") == F.col("again"))
    listed = places.groupBy("doc_key", "wide").agg(F.collect_set("at").alias("places"))

    def of(wide: bool) -> DataFrame:
        mine = listed.where(F.col("wide") == wide).select(F.col("doc_key").alias("l_key"), "places")
        return _whole_rows(docs, doc_id, text, carry or []).join(mine, F.col("doc_key") == F.col("l_key")).select("id", "text_key", "doc", "places")

    segments = of(False).mapInArrow(_segments(size, prefix), "key long, id long, text_key long, at int, more int, ahead binary, behind binary")
    deep = segments.repartition("key").sortWithinPartitions("key", "ahead").mapInArrow(_trees(size, prefix), "id long, text_key long, first long, last long")

    wide = of(True).mapInArrow(_windows(size, prefix), "id long, text_key long, start long, w1 array<long>, w2 array<long>").select(
        "*", F.size("w1").alias("n"), F.xxhash64(F.lit(1), "w1").alias("s1"), F.xxhash64(F.lit(2), "w2").alias("s2"))
    # suffixes with equal windows: all but the least place are late as a whole, and only that one is looked at window by window
    placed = _with_least(wide, "s1", "s2")
    whole = placed.where("not is_least").select("id", "text_key", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
    single = placed.where("is_least").select("id", "text_key", "start", F.posexplode(F.arrays_zip("w1", "w2")).alias("pos", "w")).select(
        "id", "text_key", (F.col("start") + F.col("pos")).alias("start"), F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    leaves = _with_least(single, "w1", "w2").where("not is_least").select("id", "text_key", F.col("start").alias("first"), F.col("start").alias("last"))
    return deep.unionByName(whole).unionByName(leaves).unionByName(_copies(docs, doc_id, text))


def _anew(column: Column | str) -> Column:
    """A join key by which a grouped input is shuffled once more: adaptive execution divides hot keys only between plain shuffles."""
    return F.bitwise_not(column)


def _with_least(rows: DataFrame, first_key: str, second_key: str) -> DataFrame:
    """``rows`` with ``is_least``: whether ``(id, start)`` is the least of those with equal keys."""
    least = rows.groupBy(first_key, second_key).agg(F.min(F.struct("id", "start")).alias("least")).select(
        _anew(first_key).alias("l_1"), _anew(second_key).alias("l_2"), "least")
    return rows.join(least, (_anew(first_key) == F.col("l_1")) & (_anew(second_key) == F.col("l_2"))).withColumn(
        "is_least", F.struct("id", "start") == F.col("least"))


def _copies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All windows of every copy of a text but that of the least id."""
    light = _rows(docs, doc_id, text).select("id", "text_key", F.xxhash64(F.lit("copy"), "text").alias("second_key"))
    first = light.groupBy("text_key", "second_key").agg(F.min("id").alias("least"), F.max("id").alias("top")).where("least < top").select(
        _anew("text_key").alias("f_key"), _anew("second_key").alias("f_second"), "least")
    return light.join(first, (_anew("text_key") == F.col("f_key")) & (_anew("second_key") == F.col("f_second"))).where("id > least").select(
        "id", "text_key", F.lit(0).cast("long").alias("first"), F.lit(_WHOLE).alias("last"))


def remove_repeats(docs: DataFrame, size: int = 20, doc_id: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS,
                   carry: list[str] | None = None, verbatim: bool = False) -> DataFrame:
    """``id, text_key, n_words, n_removed, kept`` per document, and the columns ``carry``; ``kept`` is what stays, joined by single spaces
    (with ``verbatim``, a text of which nothing is removed stays as it is)."""
    carry = list(carry or [])
    ranges = repeated_ranges(docs, size, doc_id, text, group_rows, carry).groupBy("id", "text_key").agg(
        F.collect_set(F.struct("first", "last")).alias("ranges"))
    # joined by the key alone, so that the texts are shuffled the same way as for the trees
    by_key = ranges.groupBy(_doc_key().alias("r_key")).agg(F.collect_list(F.struct("id", "text_key", "ranges")).alias("all"))
    none = "array<struct<first:long,last:long>>"
    mine = F.flatten(F.transform(F.filter("all", lambda x: (x["id"] == F.col("id")) & x["text_key"].eqNullSafe(F.col("text_key"))), lambda x: x["ranges"]))
    joined = _whole_rows(docs, doc_id, text, carry).join(by_key, F.col("doc_key") == F.col("r_key"), "left").select(
        "id", "text_key", "doc", F.coalesce(mine, F.array().cast(none)).alias("ranges"))
    kinds = "".join(f", c_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = joined.mapInArrow(_kept(size, verbatim, len(carry)), "id long, none boolean, text_key long, n_words long, n_removed long, kept string" + kinds)
    return out.select(F.when(~F.col("none"), F.col("id")).alias("id"), "text_key", "n_words", "n_removed", "kept",
                      *[F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)])


def without_repeats(docs: DataFrame, size: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with what stays of their texts, all other columns as they are; one of which no word stays goes."""
    others = [c for c in docs.columns if c != text]
    # an own name for each column, whatever they are called
    renamed = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"o_{k}") for k, c in enumerate(others)])
    kept = remove_repeats(renamed, size, carry=[f"o_{k}" for k in range(len(others))], verbatim=True).where("n_removed = 0 or n_removed < n_words")
    places = {c: f"o_{k}" for k, c in enumerate(others)}
    return kept.select(*[F.col("kept" if c == text else places[c]).alias(c) for c in docs.columns])
