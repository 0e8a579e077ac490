"""Removed repeats against a plain search over all windows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from twinweave.llm import repeats


def plain(docs, size):
    split = [(2**63 - 1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in split:
        for s in range(len(w) - size + 1):
            k = tuple(w[s:s + size])
            least[k] = min(least.get(k, (i, s)), (i, s))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - size + 1):
            if (i, s) > least[tuple(w[s:s + size])]:
                gone |= set(range(s, s + size))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def corpus(seed, letters):
    rng = random.Random(seed)
    draw = lambda n: [rng.choice(letters) for _ in range(n)]
    passage, other = draw(15), draw(40)
    docs = []
    for i in range(40):
        w = draw(rng.randrange(40))
        if rng.random() < .5:
            w = w + passage[rng.randrange(5):] + draw(5)
        if rng.random() < .3:
            w = w + other[: rng.randrange(40)]
        docs.append((rng.randrange(10**6), " ".join(w)))
    docs += [(7, None), (8, ""), (9, "a\tb\n c"), (None, " ".join(passage * 2)), (5, "same " * 90), (3, "x y " * 50), (4, "x y " * 50)]
    docs += [docs[0], docs[3], (11, docs[5][1]), (12, docs[5][1])]
    return docs


@pytest.mark.parametrize("seed,letters,size,group_rows", [
    (1, "abcdefgh", 6, 10_000), (2, "ab", 6, 10_000), (3, "abc", 7, 3), (4, "abcdé", 2, 10_000), (5, "abcdefghijklmnop", 20, 1), (6, "ab", 12, 40)])
def test_repeats_match_a_plain_search(spark, seed, letters, size, group_rows):
    docs = corpus(seed, letters)
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, kept string").repartition(3)
    got = repeats.remove_repeats(frame, size, group_rows=group_rows)
    assert sorted((2**63 - 1 if r.id is None else r.id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == plain(docs, size)


def test_very_long_texts_and_empty_tables(spark):
    words = ["w%d" % (k % 7919) for k in range(30_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[5000:9000])), (3, "z" * 2_000_000)]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == plain(docs, 20)
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("group_rows", [10_000, 1])
def test_words_of_equal_low_hash_bits_are_no_repeat(spark, group_rows):
    """Two words whose 64-bit hashes agree in the lower half, at the first, a middle and the last place of a window."""
    texts = pa.array([" ".join(map(str, range(300_000)))])
    words = repeats.words_of(texts, repeats.NOT_SPACE)
    low = words.hashes().astype(np.uint32)
    order = np.argsort(low, kind="stable")
    same = np.flatnonzero(low[order[1:]] == low[order[:-1]])
    assert same.size
    docs = []
    for n, k in enumerate(same[:3]):
        one, other = str(order[k]), str(order[k + 1])
        for at in (0, 10, 19):
            for word in (one, other):
                docs.append((len(docs), " ".join([*(f"p{n}x{at}y{j}" for j in range(at)), word, *(f"s{n}x{at}y{j}" for j in range(19 - at))])))
    docs.append((1000, docs[0][1]))
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 20, group_rows=group_rows)
    assert {r.id: r.n_removed for r in got.collect()} == {i: 20 if i == 1000 else 0 for i, _ in docs}


def test_one_id_on_all_rows(spark):
    """A null or a single id on every row, and the largest id beside null."""
    base = corpus(9, "abcdefgh")
    for one in (None, 5):
        docs = [(one, t) for _, t in base]
        got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 6)
        assert sorted((2**63 - 1 if r.id is None else r.id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == plain(docs, 6)
        assert got.where("id is null").count() == (len(docs) if one is None else 0)
    got = repeats.remove_repeats(spark.createDataFrame([(2**63 - 1, "a b"), (None, "c d")], "doc_id long, text string"), 2)
    assert sorted((r.id is None, r.kept) for r in got.collect()) == [(False, "a b"), (True, "c d")]


def test_leftmost_minimum():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 8, 13):
        x = rng.integers(0, 4, 60)
        got = repeats.least_places(x, width)
        assert got.tolist() == [i + int(np.argmin(x[i:i + width])) for i in range(len(x) - width + 1)]
