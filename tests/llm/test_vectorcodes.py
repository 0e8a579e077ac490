"""Vector codes against a full search in whole numbers, and the bounds against that too."""

import hashlib
import math
import random

import numpy as np
import pytest

from twinweave.llm import vectorcodes

KIND = "vec_id long, embedding array<float>, label int, code string, x string"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    fit = [r for r in kept if len(r[1]) == width * parts]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in fit[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            held = {}
            for _, v, _ in fit:
                held.setdefault(near(v, p)[1], []).append(cut(v, p))
            for k, vs in held.items():
                new[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
        books = new
    out, total = [], {}
    for i, v, lab in fit:
        found = [near(v, p) for p in range(parts)]
        out.append((i, "".join("%02x" % k for _, k in found), sum(d for d, _ in found), lab))
        total[lab] = total.get(lab, 0) + out[-1][2]
    out = [(i, c, e, total[lab]) for i, c, e, lab in out] + [(i, None, None, total.get(lab)) for i, v, lab in kept if len(v) != width * parts]
    flat = [x for b in books for e in b for x in e]
    return out, hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in (r[0], r[1] or "", r[2], r[3])))


def vectors(seed, n, size, spread=1.0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, spread) for _ in range(size)] for _ in range(12)]
    rows = []
    for i in range(n):
        m = rng.choice(middle)
        rows.append((rng.randrange(10**9), [x + rng.gauss(0, .2) for x in m], rng.choice([None, 1, 1, 1, 2]), "clash", "y"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5)


@pytest.mark.parametrize("seed,n,size,parts,entries,rounds", [(1, 300, 16, 4, 20, 2), (2, 200, 8, 8, 64, 2), (3, 30, 12, 3, 64, 3), (4, 400, 6, 2, 17, 4), (5, 50, 4, 4, 1, 2)])
def test_codes_match_a_full_search(spark, seed, n, size, parts, entries, rounds):
    rows = vectors(seed, n, size)
    rows += [(1, None, 1, "c", "y"), (2, [None] + [0.] * (size - 1), 1, "c", "y"), (3, [float("nan")] * size, 1, "c", "y"), (4, [float("inf")] * size, 1, "c", "y")]
    rows += [(None, rows[5][1], 2, "c", "y"), rows[7], rows[7], (rows[8][0], rows[9][1], None, "c", "y"), (10**10, [0.] * (size + 1), 1, "c", "y"), (10**10, [], None, "c", "y")]
    coded, books = vectorcodes.compress(frame(spark, rows), parts, entries, rounds)
    got = vectorcodes.with_label_errors(coded)
    expected, digest = brute(rows, parts, entries, rounds)
    assert order([(r.id, r.code, r.error, r.label_error) for r in got.collect()]) == order(expected)
    assert books.digest() == digest
    assert len(books.books) == rounds + 1


def test_bounds_leave_out_work(spark):
    coded, books = vectorcodes.compress(frame(spark, vectors(6, 2000, 16, 3.0)), 4, 64, 2)
    full = 3 * 4 * books.groups
    assert coded.agg({"measured": "avg"}).first()[0] < .7 * full


def test_net_displacement_is_tighter_than_drift():
    """An entry that went away and came back has moved nowhere."""
    a = np.zeros((1, 8, 2), np.int64)
    history = vectorcodes.Codebooks([a, a + 50, a])
    assert history.moved()[0, 0].max() == 0 < history.moved()[0, 1].min()


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [float(i % 2)] * 4, 1, "c", "y") for i in range(6)]
    coded, _ = vectorcodes.compress(frame(spark, rows), 2, 4, 2)
    assert {(r.id % 2, r.code) for r in coded.collect()} == {(0, "0000"), (1, "0101")}


def test_empty_tables_and_lengths_that_do_not_divide(spark):
    coded, books = vectorcodes.compress(frame(spark, []), 4)
    assert books is None and vectorcodes.with_label_errors(coded).count() == 0
    coded, books = vectorcodes.compress(frame(spark, [(1, [1., 2., 3.], 1, "c", "y")]), 2)
    assert books is None and [(r.id, r.code, r.error) for r in coded.collect()] == [(1, None, None)]
    with pytest.raises(Exception, match="do not fit"):
        vectorcodes.compress(frame(spark, [(1, [1e30, 2.], 1, "c", "y")]), 2)[0].collect()


def test_long_vectors(spark):
    rows = vectors(8, 12, 4096)
    coded, _ = vectorcodes.compress(frame(spark, rows))
    expected, _ = brute(rows, 16, 64, 2)
    assert sorted((r.id, r.code, r.error) for r in coded.collect()) == sorted(r[:3] for r in expected)
