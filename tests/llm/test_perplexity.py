"""The base counts, the model and the bands against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from twinweave.llm import perplexity

KIND = "doc_id long, text string, lang string, kept string, nats string, tag string"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    held = Counter(zip(words, words[1:], words[2:]))
    in_twice = {j for k, w in enumerate(zip(words, words[1:], words[2:])) if held[w] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(in_twice)


def symbols(text):
    raw = re.sub(rb"[\x20\x09-\x0D]+", b" ", (text or "").encode()).lstrip(b" ")
    return [int(perplexity.TABLE[b]) for b in raw]


class Plain:
    """Modified Kneser-Ney over tuples of symbols."""

    def __init__(self, texts, order):
        self.order = order
        count = Counter()
        for t in texts:
            s = [0] * (order - 1) + symbols(t)
            count.update(tuple(s[k - order + 1:k + 1]) for k in range(order - 1, len(s)))
        self.levels = {order: count}
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.off, self.total, self.left = {}, {}, {}
        for n, level in self.levels.items():
            of = Counter(level.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] else .5
            off = [0] + [min(k * .99, max(.01, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] else k * .5 for k in (1, 2, 3)]
            total, left = Counter(), defaultdict(float)
            for g, c in level.items():
                total[g[:-1]] += c
                left[g[:-1]] += off[min(c, 3)]
            self.off[n], self.total[n], self.left[n] = off, total, left

    def p(self, g):
        n = len(g)
        if not n:
            return 1 / perplexity.SYMBOLS
        lower = self.p(g[1:])
        if not self.total[n][g[:-1]]:
            return lower
        c = self.levels[n][g]
        return (c - self.off[n][min(c, 3)] + self.left[n][g[:-1]] * lower) / self.total[n][g[:-1]] if c else self.left[n][g[:-1]] * lower / self.total[n][g[:-1]]

    def nats(self, text):
        s = [0] * (self.order - 1) + symbols(text)
        logs = [math.log(self.p(tuple(s[k - self.order + 1:k + 1]))) for k in range(self.order - 1, len(s))]
        return -sum(logs) / len(logs) if logs else None


def texts(seed, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé中z#1.") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    out = [rng.choice(["", " "]) + " ".join(rng.choice(words) for _ in range(rng.randrange(120))) + rng.choice(["", "\n", "\n\nx | y"]) for _ in range(n)]
    return out + [None, "", " \t\n", "a", "same line\nsame line\n \nsame line", "ab " * 80, "\x00\x7f\x1b", out[0], out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "x", "y") for i, t, lang in rows], KIND).repartition(3)


def test_base_counts_and_perplexity(spark):
    found = texts(1)
    rows = [(k, t, "en") for k, t in enumerate(found)] + [(None, found[3], None)]
    docs = frame(spark, rows)
    model = perplexity.train(docs)
    plain = Plain([t for _, t, _ in rows], perplexity.ORDER)
    got = perplexity.judge(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        t = by_id[r.id]
        counts = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        want = plain.nats(t)
        assert (r.nats is None) == (want is None) and (want is None or r.nats == pytest.approx(want, rel=1e-5))
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_probabilities_add_up(order):
    column = pa.array([t for t in texts(2)])
    keys, _ = perplexity.ngrams(column, order)
    own, counts = np.unique(keys, return_counts=True)
    model = perplexity.Model.of(own, counts, order)
    rng = np.random.default_rng(1)
    for context in [0, *rng.integers(0, 64 ** (order - 1), 20), *(own[:20] >> 6)]:
        every = (np.uint32(context) << np.uint32(6)) + np.arange(64, dtype=np.uint32)
        assert np.exp(model.log_probability(every)).sum() == pytest.approx(1, abs=1e-4)


def test_bands_per_language_reject_both_ends(spark):
    rng = random.Random(3)
    speech = {"a": "lorem ipsum dolor sit amet consectetur".split(), "b": "zwölf boxkämpfer jagen viktor quer über".split(), None: "sphinx of black quartz judge my vow".split()}
    rows, bad = [], []
    for k in range(240):
        lang = [None, "a", "b", "a"][k % 4]
        rows.append((k, " ".join("".join(rng.sample(w, 2)) if rng.random() < .2 else w for w in rng.choices(speech[lang], k=120)), lang))
    for k, lang in ((900, "a"), (901, "b"), (902, None)):
        rows.append((k, " ".join("".join(rng.choice("qxzjkvw") for _ in range(8)) for _ in range(120)), lang))
        bad.append(k)
    rows.append((903, " ".join("l" * 7 + "%s" % "lrlr"[: k % 4] for k in range(300)), "a"))
    docs = frame(spark, rows)
    got = perplexity.judge(docs, perplexity.train(docs)).collect()
    kept = {r.id for r in got if r.kept}
    assert kept == {r.id for r in got if not r.base_failed} - set(bad) and len(kept) >= 200
    limits = {r.lang: (r.low, r.high) for r in got}
    assert len(limits) == 3 and len(set(limits.values())) == 3
    # the bounds are the quartiles of bins, moved by the reach
    for lang, (low, high) in limits.items():
        bins = sorted(math.floor(r.nats / perplexity.STEP) for r in got if r.lang == lang and not r.base_failed)
        q1, q3 = (bins[-(-k * len(bins) // 4) - 1] for k in (1, 3))
        spread = max((q3 + 1 - q1) * perplexity.STEP, perplexity.LEAST_SPREAD) * perplexity.REACH
        assert low == pytest.approx(q1 * perplexity.STEP - spread) and high == pytest.approx((q3 + 1) * perplexity.STEP + spread)
    assert sorted(r.doc_id for r in perplexity.keep_fluent(docs, perplexity.train(docs)).collect()) == sorted(kept)
    assert perplexity.keep_fluent(docs, None).columns == docs.columns


def test_counts_grow_with_the_corpus(spark):
    """All texts are counted: twice the rows, twice the counts."""
    docs = frame(spark, [(k, t, "en") for k, t in enumerate(texts(4))])
    counted = lambda d: d.select("text").mapInArrow(perplexity._counted, "key int, n long").agg({"n": "sum"}).first()[0]
    assert counted(docs.union(docs)) == 2 * counted(docs) == 2 * sum(len(symbols(t)) for t in texts(4))


def test_empty_tables_and_very_long_texts(spark):
    none = frame(spark, [])
    assert perplexity.train(none) is None and perplexity.judge(none, None).count() == 0
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400_000))
    docs = frame(spark, [(1, long, "en"), (2, "z" * 3_000_000, "en"), (3, None, "en")])
    got = {r.id: r for r in perplexity.judge(docs, perplexity.train(docs)).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == base(long)
    assert got[2].base_failed and got[3].nats is None and not got[3].kept


def test_case_digits_and_letters_beyond_ascii_are_told_apart(spark):
    """Texts that differ in one byte of a class: each odd one is less likely than the text all others repeat."""
    spaces = b" \t\n\v\f\r"
    assert len({int(perplexity.TABLE[b]) for b in range(256) if b not in spaces}) == 250
    assert {int(perplexity.TABLE[b]) for b in spaces} == {0} and 0 not in {int(perplexity.TABLE[b]) for b in range(256) if b not in spaces}
    common = " ".join(f"lorem ipsum {k % 10}1 (dolor) где мир 中文" for k in range(60))
    odd = [common.replace(x, y) for x, y in (("lorem", "LOREM"), ("1", "2"), ("(", "{"), ("мир", "Ьир"), ("中", "丽"), ("文", "斗"), ("где", "гдх"))]
    rows = [(k, common, "en") for k in range(9)] + [(100 + k, t, "en") for k, t in enumerate(odd)]
    got = {r.id: r.nats for r in perplexity.judge(frame(spark, rows), perplexity.train(frame(spark, rows))).collect()}
    plain = Plain([t for _, t, _ in rows], perplexity.ORDER)
    assert all(got[k] == pytest.approx(plain.nats(t), rel=1e-5) for k, t, _ in rows)
    assert all(got[100 + k] > got[0] * 1.001 for k in range(len(odd)))


def test_counts_and_models_made_in_steps(monkeypatch):
    column = pa.array(texts(6) + ["\U0010ffff\x00 Ж" * 9])
    whole = perplexity.ngrams(column, perplexity.ORDER, perplexity.BYTES)[0]
    own, counts = np.unique(whole, return_counts=True)
    batches = [pa.RecordBatch.from_arrays([column.slice(k, 1)], names=["text"]) for k in range(len(column))]
    table = pa.Table.from_batches(perplexity._counted(iter(batches)))
    assert (table["key"].to_numpy().view(np.uint32) == own).all() and (table["n"].to_numpy() == counts).all() and own.max() >= 1 << 31
    at_once = perplexity.Model.of(own, counts, perplexity.ORDER, perplexity.BYTES)
    monkeypatch.setattr(perplexity, "_AT_ONCE", 7)
    in_steps = perplexity.Model.of(own, counts, perplexity.ORDER, perplexity.BYTES)
    for a, b in zip(at_once.grams + at_once.contexts, in_steps.grams + in_steps.contexts):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    for context in [0, *(own[::97] >> 8)]:
        every = (np.uint32(context) << np.uint32(8)) + np.arange(256, dtype=np.uint32)
        assert np.exp(at_once.log_probability(every)).sum() == pytest.approx(1, abs=1e-4)
