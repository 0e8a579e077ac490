"""Benchmark windows against a plain search."""

import random
import re

import duckdb

from twinweave.llm import catalog, decontaminate as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, size):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        n = min(size, len(theirs))
        wins = {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(own), len(hit), sorted(names)


def corpus():
    rng = random.Random(5)
    draw = lambda n: [rng.choice("ab bc Cd dé 3 zz".split()) for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([0, 2, 3, 4, 8, 12])))) for i in range(12)] + [(3, "zz, ZZ; zz! dé"), (99, None), (None, "ab bc")]
    docs = [(i, " ".join(draw(rng.choice([0, 1, 3, 30, 60])))) for i in range(60)]
    docs += [(60, None), (61, ""), (None, "zz zz zz dé")] + [(62, "ab..bc\nCD-dé")] * 3 + [(63, "q" * 3000 + " ab " * 5000)]
    return docs, items


def check(spark, size, block_bytes):
    docs, items = corpus()
    got = de.find_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                       size, block_bytes=block_bytes).withColumn("n_hit", de.hit_words()).collect()
    items = [x for x in items if x[0] is not None]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(((i, *plain(t, items, size)) for i, t in docs), key=key)
    for r in got:
        assert all(x["first"] <= x["last"] and x["start"] < x["stop"] for x in r.hits)


def test_hits_match_a_plain_search(spark):
    check(spark, 4, de.BLOCK_BYTES)
    check(spark, 10, de.BLOCK_BYTES)


def test_more_than_one_block_gives_the_same(spark):
    check(spark, 4, 60)


def test_blocks_with_equal_hits_keep_all_item_ids(spark):
    # the same hit runs are found in several passes, for other items each
    items = [(i, "one two three four") for i in range(12)]
    docs = [(1, "Zero one two THREE four. End")] * 2 + [(2, "nothing here")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (de.BLOCK_BYTES, 60):
        got = de.find_hits(*tables, 4, block_bytes=block_bytes).withColumn("n_hit", de.hit_words()).collect()
        assert sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i, *plain(t, items, 4)) for i, t in docs)


def test_items_without_id_count_as_in_the_sql(spark, tmp_path):
    a, b, c = (" ".join(f"{k}{n}" for n in range(12)) for k in "abc")
    items = spark.createDataFrame([(None, a), (None, b), ("5", b), (None, None), (None, "xx yy"), ("7", c)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "so " + a), (2, b), (3, "no hit"), (4, a + " " + b + " " + c), (5, "xx, YY"), (6, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items.coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}.parquet/*.parquet'")
    want = sorted(con.sql(catalog.SQL["op7_decontamination"]).fetchall())
    assert [(r[0], r[2], r[5]) for r in want] == [(1, 12, True), (2, 12, True), (3, 0, False), (4, 36, True), (5, 2, True), (6, 0, False)]
    assert sorted(map(tuple, catalog.QUERIES["op7_decontamination"](spark, str(tmp_path)).collect())) == want
    parts = de.find_hits(docs, items, block_bytes=60, nameless=True)
    one = de.find_hits(docs, items, nameless=True)
    order = lambda x: sorted((r.id, r.n_words, r.n_hit, str(r["items"])) for r in x.withColumn("n_hit", de.hit_words()).collect())
    assert order(parts) == order(one)
    assert sorted(r.doc_id for r in de.decontaminate(docs, items).collect()) == [3, 6]


def test_decontaminate_removes_documents_or_spans(spark):
    docs = spark.createDataFrame([(1, "Keep. one TWO three four. End", "a"), (2, "one two three", "b"), (3, None, "c"), (1, "Keep. one TWO three four. End", "a")],
                                 "doc_id long, text string, hits string")
    items = spark.createDataFrame([(7, "one two, three four")], "item_id long, text string")
    assert sorted((r.doc_id, r.hits) for r in de.decontaminate(docs, items, 3).collect()) == [(3, "c")]
    spans = de.decontaminate(docs.drop("hits"), items, 4, action="span")
    assert sorted(((r.doc_id, r.text) for r in spans.collect()), key=str) == [(1, "Keep. . End")] * 2 + [(2, "one two three"), (3, None)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert de.find_hits(docs, items).count() == 0 and de.decontaminate(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert de.find_hits(one, items).first().hits == []


def test_other_columns_stay_whatever_they_are_called(spark):
    names = ["_hit_runs", "runs", "doc", "hit_id", "own_id", "hits"]
    docs = spark.createDataFrame([(1, "Keep. one TWO three four. End", *names), (2, "clean", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(7, "one two, three four")], "item_id long, text string")
    assert [tuple(r) for r in de.decontaminate(docs, items, 4).collect()] == [(2, "clean", *names)]
    spans = de.decontaminate(docs, items, 4, action="span")
    assert spans.columns == docs.columns
    assert sorted(map(tuple, spans.collect())) == [(1, "Keep. . End", *names), (2, "clean", *names)]


def test_touching_runs_are_one_run_in_any_number_of_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Keep a b, c d. end")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "zz yy")], "item_id long, text string")
    found = []
    for block_bytes in (de.BLOCK_BYTES, 10):
        hits = de.find_hits(docs, items, 2, block_bytes=block_bytes)
        found.append([(x["first"], x["last"], x["start"], x["stop"]) for x in hits.first().hits])
        monkeypatch.setattr(de.find_hits, "__defaults__", (*de.find_hits.__defaults__[:-2], block_bytes, False))
        assert [r.text for r in de.decontaminate(docs, items, 2, action="span").collect()] == ["Keep . end"]
    assert found[0] == found[1] == [(1, 4, 5, 13)]


def test_equal_items_are_one_and_short_items_fill_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x a b y"), (2, "none")], "doc_id long, text string")
    equal = spark.createDataFrame([(5, "a b")] * 400, "item_id long, text string")
    made, build = [], de.Table.__init__

    def counted(self, names, texts, size):
        made.append(len(names))
        build(self, names, texts, size)

    monkeypatch.setattr(de.Table, "__init__", counted)
    assert sorted((r.id, r["items"]) for r in de.find_hits(docs, equal, 2, block_bytes=2000).collect()) == [(1, ["5"]), (2, [])]
    assert made == [1]
    many = spark.createDataFrame([(k, "a b") for k in range(400)], "item_id long, text string")
    got = de.find_hits(docs, many, 2, block_bytes=2000).where("id = 1").first()
    assert len(got["items"]) == 400 and max(made) < 60
