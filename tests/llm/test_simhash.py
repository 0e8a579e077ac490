"""SimHash components against a plain computation of every pair."""

import random
import re

import xxhash

from twinweave.llm import simhash
from twinweave.llm.components import components


def plain_print(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    label = dict(zip(ids, ids))
    moved = True
    while moved:
        moved = False
        for i, p in zip(ids, prints):
            for j, q in zip(ids, prints):
                if (p ^ q).bit_count() <= 2 and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def corpus():
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(60)] + ["Ünï", "ABC", "x y"]
    texts = [None, "", "  \n", "one", "One two", "one\ttwo"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        texts += [" ".join(base)] * 2
        for _ in range(4):
            edited = list(base)
            edited[rng.randrange(120)] = "changed%d" % rng.randrange(9)
            texts.append(" ".join(edited))
            base = edited
    texts.append("long " * 40_000)
    return list(enumerate(texts, start=5))


def test_near_duplicates_match_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component long")
    got = {r.id: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_print(t, 3) for _, t in rows]
    label = plain_components([i for i, _ in rows], prints)
    assert got == {i: (p, label[i]) for (i, _), p in zip(rows, prints)}
    assert len(set(label.values())) < len(rows) - 15
    kept = simhash.deduplicate(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values())) and kept.columns == docs.columns


def test_links_connect_all_pairs_within_the_radius(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        values |= {x} | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(5)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    assert all(1 <= ((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in found)
    label = plain_components(signed, [v % 2**64 for v in signed])
    got = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in signed} == label


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7000, 7000), (-5, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: -5 for i in range(301)} | {-5: -5} | {1000 + i: 1000 for i in range(200)}


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d")] * 3 + [(None, "a b c d"), (None, "q"), (None, "q")], "doc_id long, text string")
    assert sorted((r.id is None, r.component) for r in simhash.near_duplicates(docs).where("component is not null").collect()) == [(False, 1)] * 3 + [(True, 1)]
    assert sorted((r.doc_id or 0, r.text) for r in simhash.deduplicate(docs).collect()) == [(0, "q"), (1, "a b c d")]


def test_other_columns_stay_whatever_they_are_called(spark):
    names = ["_d0", "_d1", "d0", "k0", "doc", "fp", "id", "d2"]
    docs = spark.createDataFrame([(1, "a b c d", *names), (2, "a b c d", *names), (3, "other words are here", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a b c d", *names), (3, "other words are here", *names)]
