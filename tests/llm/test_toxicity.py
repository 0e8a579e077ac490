"""Noisy-or over sentences: gradients through held-out accuracy, located sentences and defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinweave.llm import toxicity
from twinweave.llm.langid import held_out
from twinweave.llm.words import WORD_BYTES, words_of

BAD = ["grmblix", "vorpalus", "snirkel", "bodrux"]


def documents(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(300)] + ["grove", "body", "été"]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))]
        toxic = int(rng.random() < .3)
        if toxic:
            at = rng.randrange(len(lines))
            lines[at] += " " + rng.choice(BAD).upper() + rng.choice(["", "", "ish"])
        rows.append((i, ". ".join(lines), toxic))
    return rows


def test_sentences_end_at_marks_and_texts():
    words = words_of(pa.array(["a b. c!d", None, "e\nf g", "h"]), WORD_BYTES, lower=True)
    assert toxicity.sentences(words).tolist() == [0, 0, 1, 2, 3, 4, 4, 5]


def test_noisy_or():
    z = np.array([0.0, 0.0, -800.0, 800.0])
    assert np.allclose(toxicity.noisy_or(z, np.array([0, 0, 1, 3]), 4), [.75, 0, 0, 1])


def test_held_out_documents_and_located_sentences(spark):
    rows = documents(500)
    extra = [(900, None), (901, ""), (902, "..!!"), (None, "grmblix"), (903, "w1 w2. " * 30_000 + "snirkel w3. w4"), (904, "w1. w2"), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, .5, "x") for i, t in [(i, t) for i, t, _ in rows] + extra], "doc_id long, text string, score double, label string").repartition(3)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (900, None, 1), (7777, 1, 1)], "doc_id long, toxic int, label int")
    model = toxicity.train(docs, labels, ~held_out(F.col("id"), 3, 1))
    got = toxicity.score(docs, model, locate=2).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    by = {r.id: r for r in got}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean([(by[i].score >= .7) == y for i, _, y in held]) > .97
    for i, t, y in held:
        if y and by[i].score >= .7:
            worst = by[i].sentences[0]
            assert any(b in t.encode()[worst.start:worst.stop].decode().lower() for b in BAD)
    assert by[900].score == by[901].score == by[902].score == 0 and by[904].score < .3
    assert by[903].score > .7 and by[903].sentences[0].start == 7 * 30_000 and by[None].score > .7
    assert len({r.score for r in got if r.id == 3}) == 1


def test_one_kind_of_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).collect()] == [0, 0]
    empty = toxicity.train(docs.where("false"), labels.where("false"), F.lit(True))
    assert toxicity.score(docs.where("false"), empty).count() == 0
