"""Quality rules by n-gram perplexity: a modified Kneser-Ney model of the whole corpus and bands per language.

1. **Symbols.** A text is read as UTF-8 bytes, and every byte that is no white space is a symbol of its own (``TABLE``): letters of either case, digits, marks and all
   bytes of longer characters stay apart. A run of white space is one symbol, and ``ORDER - 1`` of these stand before a text. An n-gram is packed in one number of
   32 bits, a hash without collisions.
2. **Counting.** Every task counts the n-grams of all its texts in sorted arrays and hands on one row per distinct n-gram; Spark adds them up. No
   text is left out or cut.
3. **Model.** Modified Kneser-Ney (three discounts per order from the counts of counts, continuation counts below the highest order, interpolated down to the uniform
   distribution). It is kept as sorted arrays of packed n-grams with their log-probabilities and of contexts with their
   back-off weights and broadcast; a lookup is a binary search. It grows with the distinct n-grams of the corpus, 8 bytes for each n-gram and each context of each
   order; nothing bounds it but the 2^32 n-grams there are.
4. **Bands.** A document's value is its mean negative log-probability per symbol, the logarithm of the perplexity. Per language the quartiles of all documents that pass
   the base rules are taken from exact counts in bins of ``STEP``. A document is rejected beyond ``REACH`` times the distance of the
   quartiles (at least ``LEAST_SPREAD``) below the first or above the third: lower values are repetition, higher ones are no language.

Defined cases: a null text has no words and no symbols, like an empty one; a text without symbols has no perplexity and fails the base rules; null languages are a group
of their own; repeated rows are counted and judged each; a document that lies on a bound is kept; an empty table has no model and an empty result. Very long texts are
read whole. Other columns, whatever they are called, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from twinweave.llm.words import NOT_SPACE, Words, flat, mixed, rolled, slices, words_of
from twinweave.session import durable

ORDER = 4
STEP = 0.001
REACH = 4.0
LEAST_SPREAD = 0.05
#: N-grams whose probabilities are worked out at once.
_AT_ONCE = 1 << 20
#: Words a document needs, and the percentage of its words that may lie in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _table() -> np.ndarray:
    """The symbol of each byte: white space 0, all others themselves but for the byte 0, which has the free number of the blank."""
    out = np.arange(256, dtype=np.uint32)
    out[0] = 0x20
    out[~NOT_SPACE] = 0
    return out


def _classes() -> np.ndarray:
    """A coarse class of each byte: white space 0, letters 1-26, digits 27, five kinds of marks, control characters 33, bytes of longer characters 34-63."""
    out = np.full(256, 32, np.uint32)
    out[:0x20] = out[0x7F] = 33
    out[~NOT_SPACE] = 0
    for first in (0x41, 0x61):
        out[first:first + 26] = np.arange(1, 27)
    out[0x30:0x3A] = 27
    for mark, classed in ((".", 28), (",", 29), ("'", 30), ('"', 30), ("-", 31), ("_", 31)):
        out[ord(mark)] = classed
    out[0x80:0xC0] = 34 + (np.arange(0x80, 0xC0) & 15)
    out[0xC0:] = 50 + np.minimum(12, (np.arange(0xC0, 0x100) - 0xC0) // 4)
    return out


@dataclass(frozen=True, eq=False)
class Alphabet:
    """The symbol of each byte, 0 for white space, and the bits a symbol takes."""

    table: np.ndarray
    bits: int


#: What ``train`` and ``score`` read texts in: nothing but white space is folded.
BYTES = Alphabet(_table(), 8)
#: What ``ngrams`` and ``Model.of`` take if no alphabet is named. No query does: texts that differ in case, digits or letters beyond ASCII are alike in it.
CLASSES = Alphabet(_classes(), 6)
TABLE, SYMBOLS = BYTES.table, 1 << BYTES.bits


def ngrams(column: pa.Array, order: int = ORDER, alphabet: Alphabet = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each symbol of all texts (the latest symbol in the lowest bits), and the row it is of."""
    data, offsets = flat(column)
    symbols = alphabet.table[data]
    blank = symbols == 0
    again = np.ones(len(blank), bool)
    again[1:] = blank[:-1]
    again[offsets[:-1][np.diff(offsets) > 0]] = True
    kept = ~(blank & again)
    upto = np.concatenate([[0], np.cumsum(kept)])
    counts = upto[offsets[1:]] - upto[offsets[:-1]]
    row = np.repeat(np.arange(len(counts)), counts)
    pad = order - 1
    at = np.arange(len(row)) + pad * (row + 1)
    line = np.zeros(len(row) + pad * len(counts), np.uint32)
    line[at] = symbols[kept]
    keys = line[at]
    for back in range(1, order):
        keys |= line[at - back] << np.uint32(alphabet.bits * back)
    return keys, row


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _merged(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([k for k, _ in tallies]), np.concatenate([n for _, n in tallies]))


def _tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there."""
    keys = np.sort(keys)
    first = _firsts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, new, waiting = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), [], 0
    for part in slices(batches):
        new.append(_tallied(ngrams(part.column("text"), ORDER, BYTES)[0]))
        waiting += len(new[-1][0])
        if waiting >= len(done[0]):  # so a key is merged a few times, however many slices there are
            done, new, waiting = _merged([done, *new]), [], 0
    keys, counts = _merged([done, *new])
    for at in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 16)].view(np.int32)), pa.array(counts[at:at + (1 << 16)], pa.int64())], names=["key", "n"])


def _discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, 3 or more; within (0, count) whatever the counts of counts are."""
    n = np.array([(counts == k).sum() for k in range(5)], float)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    out = np.zeros(4)
    for k in (1, 2, 3):
        out[k] = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5
    return np.clip(out, [0, .01, .01, .01], [0, .99, 1.98, 2.97])


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``sorted_keys``, and whether the key is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


@dataclass
class Model:
    """Per order from 1 up: sorted n-grams with log-probabilities, sorted contexts with logarithms of their back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    bits: int

    @property
    def order(self) -> int:
        return len(self.grams)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, alphabet: Alphabet = CLASSES) -> Model:
        """From the counts of all n-grams of the highest order."""
        bits = alphabet.bits
        levels = [_summed(keys.astype(np.uint32, copy=False), counts.astype(np.int64, copy=False))]
        for n in range(order - 1, 0, -1):
            levels.append(_tallied(levels[-1][0] & np.uint32((1 << bits * n) - 1)))  # in how many ways it is continued to the left
        grams, contexts = [], []
        below = np.zeros(0)
        for n in range(1, order + 1):
            own, count = levels.pop()
            off = _discounts(count)
            first = _firsts(own >> np.uint32(bits))
            ends = np.append(first, len(own))
            own_p, logs, back = np.empty(len(own) if n < order else 0), np.empty(len(own), np.float32), np.empty(len(first), np.float32)
            at = 0
            while at < len(first):  # whole contexts, about ``_AT_ONCE`` n-grams at once: the driver holds little beside the model
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + _AT_ONCE, side="right")) - 1)
                here, starts = slice(ends[at], ends[to]), first[at:to] - first[at]
                taken = off[np.minimum(count[here], 3)]
                total = np.add.reduceat(count[here], starts)
                weight = np.add.reduceat(taken, starts) / total
                of = np.repeat(np.arange(to - at), np.diff(ends[at:to + 1]))
                lower = 1 / (1 << bits) if n == 1 else below[_find(grams[-1][0], own[here] & np.uint32((1 << bits * (n - 1)) - 1))[0]]
                p = (count[here] - taken) / total[of] + weight[of] * lower
                logs[here], back[at:to] = np.log(p), np.log(weight)
                if n < order:
                    own_p[here] = p
                at = to
            below = own_p
            grams.append((own, logs))
            contexts.append((own[first] >> np.uint32(bits), back))
        return cls(grams, contexts, bits)

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Of the last symbol of each n-gram after the symbols before it."""
        out = np.zeros(len(keys), np.float64)
        left = np.arange(len(keys))
        for n in range(self.order, 0, -1):
            mine = keys[left] & np.uint32((1 << self.bits * n) - 1)
            at, there = _find(self.grams[n - 1][0], mine)
            if there.all():
                out[left] += self.grams[n - 1][1][at]
                return out
            out[left[there]] += self.grams[n - 1][1][at[there]]
            left, mine = left[~there], mine[~there]
            at, there = _find(self.contexts[n - 1][0], mine >> np.uint32(self.bits))
            out[left[there]] += self.contexts[n - 1][1][at[there]]
        out[left] -= np.log(1 << self.bits)
        return out


def train(docs: DataFrame, text: str = "text") -> Model | None:
    """The model of all texts; None without a symbol. A count for each distinct n-gram comes to the driver."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_counted, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    keys, n = (counts.column(c).to_numpy() for c in ("key", "n"))
    del counts
    return Model.of(keys.view(np.uint32), n, ORDER, BYTES)


_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """Per row: words in windows of ``size`` words that are there twice or more in that row."""
    starts = words.window_starts(size)
    row = words.row_of()
    with np.errstate(over="ignore"):
        keys = mixed(rolled(words.hashes(), size)[starts] + mixed(row[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(row) + 1, np.int64)
    for step in range(size):
        cover[starts[twice] + step] = 1
    return _per_row(cover[:-1], words.first)


def _repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]  # for bytes: 0x20, 0x09-0x0D
    return len(lines) - len(set(lines))


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for part in slices(batches):
            column = part.column("text")
            words = words_of(column, NOT_SPACE)
            data, offsets = words.data, words.offsets
            chars = _per_row(((data & 0xC0) != 0x80) & NOT_SPACE[data], offsets)
            lines = [_repeated_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            keys, row = ngrams(column, ORDER, BYTES)
            symbols = np.bincount(row, minlength=part.num_rows)
            nats = -np.bincount(row, model.log_probability(keys), part.num_rows) if model is not None else np.zeros(part.num_rows)
            value = pa.array(nats / np.maximum(1, symbols), pa.float64(), mask=symbols == 0)
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("lang"), *[pa.array(x, pa.int64()) for x in (words.counts, chars, _per_row(_SYMBOL[data], offsets), lines, repeated_words(words))], value],
                names=["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "nats"])
    return run


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, lang``, the base counts, ``base_failed`` and ``nats`` (per symbol) of every whole text."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    kind = f"id {docs.schema[doc_id].dataType.simpleString()}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, nats double"
    out = rows.mapInArrow(_judged(docs.sparkSession.sparkContext.broadcast(model)), kind)
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def bands(scored: DataFrame, reach: float = REACH) -> DataFrame:
    """``lang, low, high``: the values between which a language's documents are kept, a row per language.

    Only counts per bin are ordered, of which a language has some thousands whatever the number of its documents.
    """
    bins = scored.where("NOT base_failed AND nats IS NOT NULL").groupBy("lang", F.floor(F.col("nats") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    ranked = bins.withColumn("upto", F.sum("n").over(W.partitionBy("lang").orderBy("bin"))).withColumn("total", F.sum("n").over(W.partitionBy("lang")))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))) * F.lit(STEP)
    found = ranked.groupBy("lang").agg(quartile(1).alias("q1"), (quartile(3) + F.lit(STEP)).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD)) * F.lit(reach)
    return found.select("lang", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def judge(docs: DataFrame, model: Model | None, reach: float = REACH, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``score`` with ``low, high, kept``: the verdict on every document."""
    scored = durable(score(docs, model, doc_id, text, lang))
    # a table of one row per language: Spark broadcasts it if it is small, and else adaptive execution divides hot languages
    limits = durable(bands(scored, reach)).select(F.col("lang").isNull().alias("_none"), F.coalesce("lang", F.lit("")).alias("_lang"), "low", "high")
    keyed = scored.withColumns({"_own": F.coalesce("lang", F.lit("")), "_null": F.col("lang").isNull()})
    found = keyed.join(limits, (F.col("_own") == F.col("_lang")) & (F.col("_null") == F.col("_none")), "left")
    inside = F.coalesce(F.col("nats").between(F.col("low"), F.col("high")), F.lit(False))
    return found.select(*scored.columns, "low", "high", (~F.col("base_failed") & inside).alias("kept"))


def keep_fluent(docs: DataFrame, model: Model | None, reach: float = REACH, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns: rows of equal id, text and language share one verdict."""
    marks = [F.col(doc_id).cast("string"), F.xxhash64(text), F.xxhash64(F.lit("second"), text), F.col(lang).cast("string")]
    name = F.sha2(F.to_json(F.struct(*[m.alias(f"m{k}") for k, m in enumerate(marks)])), 256)
    tagged = docs.select(name.alias("tag"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    own = "tag"
    while own in docs.columns:
        own += "_"
    good = judge(tagged, model, reach, doc_id="tag", text="text", lang="lang").where("kept").select(F.col("id").alias(own)).distinct()
    return docs.withColumn(own, name).join(good, own, "left_semi").select(*docs.columns)
