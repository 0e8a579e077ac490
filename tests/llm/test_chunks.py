"""Chunk fingerprints: boundaries, shifts, successors against a plain loop."""

import hashlib
import random

import numpy as np
import pytest

from twinweave.llm import chunks


def noise(rng, n):
    return "".join(rng.choice("abcdefghij klmno é日") for _ in range(n))




def test_chunks_have_sound_sizes_and_do_not_depend_on_neighbours():
    rng = random.Random(1)
    texts = [noise(rng, n).encode() for n in (0, 1, 15, 16, 17, 100, 5000, 0, 40)] + [b"\0" * 1000]
    together = chunks.fingerprints(texts)
    for t, f in zip(texts, together):
        assert (chunks.fingerprints([t])[0] == f).all() and (chunks.parsed(chunks.text_of(f)) == f).all()
        ends = chunks.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)])).tolist()
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(t) and all(s <= chunks.MOST for s in sizes) and all(s >= chunks.LEAST for s in sizes[:-1])
    sizes = np.diff(chunks.chunk_ends(np.frombuffer(texts[6], np.uint8), np.array([0, len(texts[6])])))
    assert 25 < sizes.mean() < 90


def test_likeness_resists_shifts_and_measures_containment():
    rng = random.Random(2)
    base, other = noise(rng, 4000), noise(rng, 4000)
    f = lambda t: chunks.fingerprints([t.encode()])[0]
    assert chunks.likeness(f(base), f(base)) == 1 and chunks.likeness(f(base), f(other)) < .05
    assert chunks.likeness(f(base), f("xy" + base[:2000] + "new words" + base[2010:])) > .9
    assert chunks.likeness(f(base[1000:2500]), f(other + base)) > .85
    assert .35 < chunks.likeness(f(base), f(chunks.edited(base, other))) < .65
    assert chunks.likeness(f(""), f("")) == 1 and chunks.likeness(f(""), f(base)) == 0


@pytest.mark.parametrize("block_rows", [5000, 7, 1])
def test_neighbours_match_a_plain_loop(spark, block_rows):
    rng = random.Random(3)
    rows = [(i, noise(rng, rng.randrange(400))) for i in rng.sample(range(-100, 1000), 60)]
    rows += [(2000, None), (2001, ""), (2002, "same"), (2002, "same"), (2002, "other one"), (None, "no id"), (2**62, noise(rng, 90_000)), (2**62 + 1, "near")]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, block int, copy string").repartition(4)
    got = chunks.neighbours(frame, block_rows=block_rows).collect()
    line = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, t), (_, following) in zip(line, line[1:] + line[:1]):
        half = len(t) // 2
        changed = t[:len(t) - half] + following[:half]
        a, b, c = (chunks.fingerprints([x.encode()])[0] for x in (t, changed, following))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), chunks.text_of(a), chunks.text_of(b), chunks.likeness(a, b), chunks.likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_row_and_empty_table(spark):
    one = chunks.neighbours(spark.createDataFrame([(1, "abcdef" * 30)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert chunks.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
