"""Search results against plain scoring, block bounds against exact scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from twinweave.llm import lexical
from twinweave.llm.words import WORD_BYTES, words_of

DOCS = "doc_id long, text string, score string, h1 string, part string"
ITEMS = "item_id long, text string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (text or "").translate(LOWER))


def plain(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, size in held:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=key)


def key(row):
    return tuple((x is None, x or 0) for x in row)


def corpus(seed, n=300, words=80):
    rng = random.Random(seed)
    speech = ["".join(rng.choice("abcdéX0") for _ in range(rng.randrange(1, 5))) for _ in range(words)]
    share = [1 / (1 + k) for k in range(words)]
    draw = lambda most: " ".join(rng.choices(speech, share, k=rng.randrange(most)))
    docs = [(rng.randrange(10**6), draw(60)) for _ in range(n)]
    docs += [(None, docs[0][1]), docs[1], docs[1], (5, None), (6, ""), (7, " .,! \n"), (8, "a " * 500)] + [(10**7 + k, docs[2][1]) for k in range(40)]
    items = [(k, draw(30)) for k in range(25)] + [(3, docs[2][1]), (100, docs[2][1]), (101, "nowhere"), (102, None), (103, "?"), (None, docs[4][1]), (0, docs[5][1])]
    return docs, items + items[:2]


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "clash", "c", "d") for i, t in docs], DOCS).repartition(6),
            spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS))


@pytest.mark.parametrize("seed,block,coordinates,query_bytes,first,k", [(1, 64, 64, 1 << 18, 16, 10), (2, 4, 64, 1 << 18, 2, 10), (3, 3, 2, 1 << 18, 2, 3), (4, 8, 64, 900, 3, 10)])
def test_results_match_plain_scoring(spark, seed, block, coordinates, query_bytes, first, k):
    docs, items = corpus(seed)
    got = lexical.search(*frames(spark, docs, items), k=k, query_bytes=query_bytes, block=block, coordinates=coordinates, first=first)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == plain(docs, [x for x in items if x[1] is not None], k)


def small_index(docs, items, k, block, matrix=1 << 24):
    words = words_of(pa.array([t for _, t in items]), WORD_BYTES, lower=True)
    hashes = words.hashes()
    held = [np.unique(hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:]) if b > a]
    vocabulary = np.unique(np.concatenate(held))

    class Shared:
        def __init__(self, value):
            self.value = value

    rows = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["id", "text"])
    counts = {}
    for out in lexical._counted(Shared(vocabulary))(iter([rows])):
        counts.update(zip(out.column("term").to_pylist(), out.column("n").to_pylist()))
    df = np.array([counts.get(t, 0) for t in range(len(vocabulary))])
    queries = lexical.Queries.of([(q, 0) for q in range(len(held))], vocabulary, held, df, counts[-1], counts[-2], k, block, matrix=matrix)
    return queries, [lexical.Slice(b.to_pylist()[0], queries) for b in lexical._indexed(Shared(queries))(iter([rows]))]


def test_bounds_hold_and_blocks_are_skipped():
    rng = random.Random(9)
    topics = [["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(25)] for _ in range(12)]
    shared = ["the", "of", "and", "in"]
    docs = [(k, " ".join(rng.choices(topics[k % 12], k=30) + rng.choices(shared, k=20))) for k in range(1500)]
    items = [(q, " ".join(topics[q][:6] + shared)) for q in range(12)]
    queries, parts = small_index(docs, items, 5, 16)
    scored = skipped = blocks = 0
    for q, terms_of_q in enumerate(queries.terms):
        best = lexical.Best(5, 1)
        weights = queries.weights[terms_of_q]
        for part in parts:
            exact = part.values[:, terms_of_q].astype(np.int64) @ weights
            seen = np.zeros(len(exact), bool)
            for i, t in enumerate(terms_of_q.tolist()):
                members, starts, summary = part.lists[t]
                bound = summary[:, queries.columns[q][i]].astype(np.int64) @ weights[i:]
                for b in range(len(bound)):
                    new = [d for d in members[starts[b]:starts[b + 1]] if not seen[d]]
                    assert all(exact[d] <= bound[b] for d in new)
                seen[members] = True
                blocks += len(bound)
            a, b = lexical.search_slice(part, queries, q, best)
            scored, skipped = scored + a, skipped + b
        every = np.concatenate([p.values[:, terms_of_q].astype(np.int64) @ weights for p in parts])
        assert sorted(best.score.tolist()) == sorted(every.tolist())[-5:]
    assert 0 < skipped and scored < blocks


def test_slices_of_few_rows_give_the_same():
    docs, items = corpus(11)
    items = [x for x in items if x[1]]
    found = []
    for matrix in (1 << 24, 700):
        queries, parts = small_index(docs, items, 10, 8, matrix)
        for q in range(len(queries.terms)):
            best = lexical.Best(10, 1)
            for part in parts:
                lexical.search_slice(part, queries, q, best)
            found.append((q, best.score.tolist(), best.doc.tolist(), best.none.tolist()))
    half = len(found) // 2
    assert found[:half] == found[half:]


def test_blocks_put_alike_documents_together():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(4, 16)) * 5
    kind = np.arange(400) % 4
    order, starts = lexical.blocked((middle[kind] + rng.normal(size=(400, 16)) * .1).astype(np.float32), 100)
    assert sorted(order.tolist()) == list(range(400))
    for a, b in zip(starts, [*starts[1:], 400]):
        assert len(set(kind[order[a:b]])) == 1


def test_empty_tables_and_very_long_texts(spark):
    docs, items = corpus(12, n=20)
    for d, i in (([], items), (docs, []), ([(1, None)], items), (docs, [(1, None), (2, "")])):
        assert lexical.search(*frames(spark, d, i)).count() == 0
    rng = random.Random(13)
    speech = ["w%d" % k for k in range(3000)]
    docs += [(1, " ".join(rng.choices(speech, k=300_000))), (2, " ".join(rng.choices(speech, k=40)))]
    items = [(1, " ".join(speech[:1500])), (2, " ".join(speech[5:20]))]
    got = lexical.search(*frames(spark, docs, items))
    assert sorted(map(tuple, got.collect()), key=key) == plain(docs, items, 10)


def test_lengths_beyond_a_long():
    n = np.array([10**9, 3], np.int64)
    assert lexical.lengths_in(n, 10**12, 10**15).tolist() == [10 + 90 * 10**9 * 10**12 // 10**15, 10]
