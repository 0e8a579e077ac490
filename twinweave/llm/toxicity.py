"""Toxicity by multiple-instance learning: only documents have labels, and sentences are found.

A sentence is scored by a logistic model of the words in it and of their beginnings (``PREFIXES`` bytes), each hashed to one of ``SLOTS`` weights.
A document is toxic if any of its sentences is, so its score is the noisy-or of theirs, ``1 - prod(1 - p)``. The gradient of the
document's loss reaches each sentence by its share in that product, which is how sentences are learned from documents' labels. Training runs
in numpy on the driver, on about ``SAMPLE_DOCS`` documents of each label; the features kept are the ``FEATURES`` whose presence depends most on the
label, so the model that is broadcast is a table of fixed size. Offending sentences are those with the largest scores.

Defined cases: a null or empty text has no sentence and score 0; copies get equal scores; a null id or null label is never learned from; a document with two different
labels counts once with each; without labels of both kinds every score is 0. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinweave.llm.sample import bounded
from twinweave.llm.words import WORD_BYTES, Words, mixed, slices, words_of

SLOTS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
FEATURES = 4096
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 1 << 16  # longer texts are not learned from
LEAST_DOCS = 3  # a feature must be in so many learned documents
ROUNDS = 150
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?\n"]] = True


def sentences(words: Words) -> np.ndarray:
    """Number of the sentence each word is in, counted over the whole slice; sentences do not reach over texts."""
    ended = np.concatenate([[0], np.cumsum(_ENDS[words.data])])
    key = ended[words.starts]
    row = words.row_of()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return np.cumsum(new) - 1


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of word numbers and slots: whole words, then beginnings of longer words."""
    every = np.arange(len(words.starts))
    out = [(every, (words.hashes() % np.uint64(SLOTS)).astype(np.int64))]
    sizes = words.ends - words.starts
    for n in PREFIXES:
        at = np.flatnonzero(sizes > n)
        part = Words(words.data, words.offsets, words.starts[at], words.starts[at] + n, words.first)
        out.append((at, (mixed(part.hashes() ^ np.uint64(n)) % np.uint64(SLOTS)).astype(np.int64)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # one per slot
    bias: float

    def sentence_scores(self, words: Words, of: np.ndarray) -> np.ndarray:
        total = np.full(int(of[-1]) + 1 if len(of) else 0, self.bias, np.float64)
        for at, slot in features(words):
            w = self.weights[slot]
            some = np.flatnonzero(w)
            total += np.bincount(of[at[some]], w[some], len(total))
        return total


def noisy_or(logits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Score of each text from its sentences' logits."""
    return -np.expm1(-np.bincount(row, np.logaddexp(0, logits), rows))


def fit(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights by Adam on the documents' loss; ``weights`` gives each document's share in it."""
    model = Model(np.zeros(SLOTS, np.float32), -np.inf)
    if not ((labels == 1).any() and (labels == 0).any()):
        return model
    words = words_of(texts, WORD_BYTES, lower=True)
    of, row = sentences(words), words.row_of()
    count = int(of[-1]) + 1 if len(of) else 0
    row_of_sentence = np.zeros(count, np.int64)
    row_of_sentence[of] = row
    n = len(labels)
    # presence in documents, by label
    pairs = [(at, slot) for at, slot in features(words)]
    seen = np.unique(np.concatenate([row[at] * SLOTS + slot for at, slot in pairs]))
    slot, toxic = seen % SLOTS, labels[seen // SLOTS] == 1
    with_1, with_0 = np.bincount(slot[toxic], minlength=SLOTS), np.bincount(slot[~toxic], minlength=SLOTS)
    n_1, n_0 = (labels == 1).sum(), (labels == 0).sum()
    both, share = with_1 + with_0, n_1 / n
    strength = np.abs(with_1 - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
    strength[both < LEAST_DOCS] = 0
    kept = np.argsort(-strength, kind="stable")[:FEATURES]
    kept = kept[strength[kept] > 0]
    place = np.full(SLOTS, -1)
    place[kept] = np.arange(len(kept))
    sentence, column = (np.concatenate(x) for x in zip(*[(of[at][place[slot] >= 0], place[slot][place[slot] >= 0]) for at, slot in pairs]))
    w, bias = np.zeros(len(kept)), -6.0
    mean, square, target = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), labels.astype(float)
    share = weights / weights.sum()
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[column], count)
        p = 1 / (1 + np.exp(-z))
        rest = np.bincount(row_of_sentence, np.logaddexp(0, z), n)  # -log prod(1 - p)
        clean = np.exp(-rest)
        # d loss / d z of a sentence: p for label 0, -p Q / (1 - Q) for label 1
        factor = share * np.where(target == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g = p * factor[row_of_sentence]
        grad = np.append(np.bincount(column, g[sentence], len(w)) + 1e-5 * w, g.sum())
        mean += .1 * (grad - mean)
        square += .01 * (grad * grad - square)
        move = .2 * (mean / (1 - .9 ** step)) / (np.sqrt(square / (1 - .99 ** step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    model.weights[kept] = w
    model.bias = float(bias)
    return model


def _scored(shared, locate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for part in slices(batches):
            words = words_of(part.column("text"), WORD_BYTES, lower=True)
            of, row = sentences(words), words.row_of()
            logits = model.sentence_scores(words, of)
            row_of = np.zeros(len(logits), np.int64)
            row_of[of] = row
            score = np.clip(noisy_or(logits, row_of, part.num_rows), 0, 1)
            arrays, names = [part.column("id"), part.column("text_key"), pa.array(score)], ["id", "text_key", "score"]
            if locate:
                first = np.searchsorted(of, np.arange(len(logits)))
                last = np.searchsorted(of, np.arange(len(logits)), side="right") - 1
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in np.lexsort((-logits, row_of)):
                    r = row_of[k]
                    if len(found[r]) < locate and logits[k] > 0:
                        base = words.offsets[r]
                        found[r].append({"start": int(words.starts[first[k]] - base), "stop": int(words.ends[last[k]] - base), "score": float(1 / (1 + np.exp(-logits[k])))})
                arrays.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))))
                names.append("sentences")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE_DOCS) -> Model:
    """``may_learn`` is a condition on the column ``id`` of the labelled documents."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(may_learn & F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    # about twice SAMPLE_DOCS ids at most, so they may be broadcast
    chosen = F.broadcast(bounded(rows, "label", ["id"], most).select(F.col("id").alias("l_id"), "label"))
    texts = docs.where(F.octet_length(text) <= SAMPLE_BYTES).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # ids that repeat in the documents count once
    found = texts.join(chosen, F.col("id") == F.col("l_id")).groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["id"], r["label"]))
    own = np.array([r["label"] for r in found], np.int64)
    weights = np.array([counts[k] / max(1, (own == k).sum()) for k in own], float)
    return fit(pa.array([r["text"] for r in found], pa.string()), own, weights)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", locate: int = 0) -> DataFrame:
    """``id, text_key, score`` of every whole text, and with ``locate`` up to so many offending ``sentences`` (bytes ``start..stop``), worst first."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    kind = f"id {docs.schema[doc_id].dataType.simpleString()}, text_key long, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared, locate), kind + (", sentences array<struct<start:long,stop:long,score:double>>" if locate else ""))
