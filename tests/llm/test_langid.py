"""The byte network: gradients, held-out accuracy and defined cases."""

import random
import zlib

import numpy as np
import pytest

from twinweave.llm import langid
from twinweave.llm.sample import bounded
from pyspark.sql import functions as F

SOUNDS = {"aa": "ba ke lo mi tu".split(), "bb": "sch ung ein ver ost".split(), "cc": "éau oiè que çon ment".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = langid.Network(["a", "b", "c"], units=3)
    for d in (net.ahead, net.behind):
        d.embed, d.recur = ([p.astype(np.float64) for p in x] for x in (d.embed, d.recur))
    net.top, net.bias = net.top.astype(np.float64), net.bias.astype(np.float64)
    x = rng.integers(0, 5, (6, 4)).astype(np.intp)
    inside, label = (np.arange(6)[:, None] < np.array([6, 4, 6, 1])).astype(float), np.array([0, 1, 2, 1])
    _, grads = net.learn(x, inside, label)
    for part, grad in zip(net.parts, grads):
        places = [tuple(rng.integers(0, s) for s in part.shape) for _ in range(3)]
        if part.shape[0] == 256:
            places = [(int(x[k, 0]), 1) for k in range(3)]
        for at in places:
            old, e = part[at], 2e-2
            part[at] = old + e
            up, _ = net.learn(x, inside, label)
            part[at] = old - e
            down, _ = net.learn(x, inside, label)
            part[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-3


def test_windows_cover_every_byte_once():
    data = np.frombuffer(b"abcdefghij" * 20, np.uint8)
    offsets = np.array([0, 0, 3, 70, 70, 200])
    x, real, row = langid.windows(data, offsets, 16)
    back = {r: b"".join(x[w, :real[w]].tobytes() for w in np.flatnonzero(row == r)) for r in range(5)}
    assert [back[r] for r in range(5)] == [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(3, 60)), lang, "s", .5) for i, lang in enumerate(list(SOUNDS) * 50)]
    rows += [(900, None, "aa", "s", .5), (901, "", "aa", "s", .5), (902, "12 -- 34", "bb", "s", .5), (None, text(rng, "bb", 30), None, "s", .5), (903, text(rng, "cc", 40_000), None, "s", .5),
             (5, rows[5][1], "cc", "s", .5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
    net = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    got = langid.predict(docs, net).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    held = [r for r in rows if r[0] is not None and r[2] and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([by[r[0]].lang_pred == r[2] for r in held]) > .95
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[None].lang_pred == "bb" and by[903].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got)
    assert len({(r.lang_pred, r.score) for r in got if r.id == 5}) == 1
    assert {n for n, _ in langid.labelled(net, rows[0][1])} <= set(SOUNDS) and len(langid.labelled(net, "éa")) == 3


def test_nothing_to_learn_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    net = langid.train(docs, F.lit(True))
    assert net is None and langid.predict(docs, net).first().lang_pred == "und"
    empty = docs.where("false")
    assert langid.predict(empty, langid.train(empty, F.lit(True))).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_bounded_sample_does_not_depend_on_partitions(spark, parts):
    frame = spark.range(4000).withColumn("label", F.when(F.col("id") < 30, "rare").otherwise("common")).repartition(parts)
    got = {r["id"] for r in bounded(frame, "label", ["id"], 100).collect()}
    assert got >= set(range(30)) and 50 < len(got) - 30 < 200
    assert sum(got) == sum(r["id"] for r in bounded(frame.coalesce(1), "label", ["id"], 100).collect())


def test_more_labels_than_a_classifier_learns_and_one_id_on_all_rows(spark):
    """2,000 labels, and repeated rows of one id: the sample stays bounded, the most frequent labels are learned."""
    frame = spark.range(6000).withColumn("label", F.concat(F.lit("l"), F.least(F.col("id") % 4000, F.lit(1999)).cast("string")))
    got = bounded(frame, "label", ["id"], 100, most_labels=50).groupBy("label").count().collect()
    assert len(got) == 50 and any(r["label"] == "l1999" and 50 < r["count"] < 200 for r in got)
    same = spark.range(5000).select(F.lit(7).alias("id"), F.lit("en").alias("label"), (F.col("id") % 2500).alias("text"))
    assert 20 < bounded(same, "label", ["id", "text"], 100).count() < 200


def test_keep_known_writes_the_language_it_finds(spark):
    names = list(SOUNDS)
    rows = [(k, " ".join(random.Random(k).choices(SOUNDS[names[k % 2]], k=40)), names[k % 2]) for k in range(80)]
    docs = spark.createDataFrame([(i, t, l if i % 4 else None, "x", "y", None) for i, t, l in rows], "doc_id long, text string, lang string, c0 string, score string, lang_pred string")
    net = langid.train(docs, F.lit(True))
    got = langid.keep_known(docs.union(docs.limit(0)), net)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == 80 and all(found[i].lang == l and found[i].c0 == "x" and found[i].lang_pred is None for i, _, l in rows)
    assert langid.keep_known(docs, None).where("lang is null").count() == 20
