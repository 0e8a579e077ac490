"""The pipeline's stages against plain versions, and its decisions."""

import random
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from twinweave.llm import tokens
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_repeats import plain as plain_repeats
from tests.llm.test_simhash import plain_components, plain_print

SOUNDS = {"aa": "ba ke lo mi tu".split(), "bb": "sch ung ein ver ost".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    item = text(rng, "aa", 30)
    passage = text(rng, "bb", 60)
    rows = []
    for i in range(90):
        lang = ("aa", "bb")[i % 2]
        body = text(rng, lang, rng.randrange(5, 120))
        if i % 9 == 4:
            body += "\n" + passage
        if i % 10 == 3:
            body = body + " " + item
        rows.append((i, body, lang, "s%d" % (i % 3), len(body)))
    rows += [(100, None, None, "s", None), (101, "", "aa", "s", 0), (102, "1 2 3", "aa", "s", 5), (103, rows[5][1], "bb", "s", 1), (104, rows[5][1], "bb", "s", 1),
             (105, "One lone text.", None, None, None), (5, *rows[5][1:])]
    return rows, item


def test_stages_match_plain_versions(spark, tmp_path):
    rows, item = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, held = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        held[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    # language: only texts without letters go
    first = {(r.doc_id, r.text) for r in held["language"]}
    assert first == {(i, t) for i, t, *_ in rows if i not in (100, 101, 102)}
    # near-duplicates: the least id of each component, once
    ids = sorted({i for i, _ in first})
    by = dict(first)
    label = plain_components(ids, [plain_print(by[i], 3) for i in ids])
    assert sorted(r.doc_id for r in held["near_duplicates"]) == sorted(set(label.values()))
    # substrings
    second = [(r.doc_id, r.text) for r in held["near_duplicates"]]
    want = {i: (n, k, t) for i, n, k, t in plain_repeats(second, 20)}
    got = {r.doc_id: r for r in held["substrings"]}
    assert set(got) == {i for i, (n, k, _) in want.items() if k == 0 or k < n}
    assert all(r.text == (want[i][2] if want[i][1] else dict(second)[i]) and r.n_chars == len(r.text) for i, r in got.items())
    assert any(k for _, k, _ in want.values())
    # benchmark
    left = {i for i, r in got.items() if not plain_hits(r.text, [(1, item)], 10)[1]}
    assert {r.doc_id for r in held["benchmark"]} == left and len(left) < len(got)
    # packing: every id of every document, once
    coder = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    for i in left:
        ids = coder.encode(got[i].text, add_special_tokens=False).ids + [1]
        pieces = sorted((r for r in held["packing"] if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(r.ids_crc32 == crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in pieces)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, held["packing"]))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null ids, a very long text, columns with names the stages might use, and empty tables."""
    rng = random.Random(3)
    names = ["_d0", "_hit_runs", "doc", "id", "text_key", "kept", "c0", "score", "lang_pred"]
    long = text(rng, "aa", 40_000)
    item = " ".join(long.split()[100:130])
    rows = [(i, text(rng, ("aa", "bb")[i % 2], 60), ("aa", "bb")[i % 2] if i % 5 else None, "s", None, *names) for i in range(40)]
    rows += [(None, text(rng, "aa", 50), None, None, 1, *names), (None, text(rng, "bb", 50), "zz", "s", 1, *names), (50, long, "aa", "s", 1, *names), (51, None, None, None, None, *names)]
    rows.append(rows[3])
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)

    def stages(rows, items, folder):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now, held = spark.createDataFrame(rows, kind).repartition(3), {}
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, now, folder)
            if name != "packing":
                assert found.dtypes == now.dtypes
            found.write.parquet(f"{folder}/{name}")
            now = spark.read.parquet(f"{folder}/{name}")
            held[name] = now.collect()
        return held

    held = stages(rows, [(1, item), (None, None)], str(tmp_path / "a"))
    first = held["language"]
    assert len(first) == len(rows) - 1 and all(r.lang is not None for r in first) and any(r.lang == "zz" for r in first)
    by = dict((i, lang) for i, _, lang, *_ in rows)
    assert all(r.lang == ("aa", "bb")[r.doc_id % 2] for r in first if r.doc_id is not None and r.doc_id < 40)
    assert len(held["near_duplicates"]) == len(rows) - 2 and sum(r.doc_id is None for r in held["near_duplicates"]) == 2 and by
    assert all([r[n] for n in names] == names for k in ("near_duplicates", "substrings", "benchmark") for r in held[k])
    assert {r.doc_id for r in held["substrings"]} - {r.doc_id for r in held["benchmark"]} == {50}
    assert sum(r.start == 0 for r in held["packing"]) == len(held["benchmark"])
    assert all(not h for h in stages([], [], str(tmp_path / "b")).values())
