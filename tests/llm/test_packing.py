"""Packing: exact round trip of ids, full sequences, and an order that keeps like documents together."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from twinweave.llm import catalog, packing, tokens

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def texts():
    rng = random.Random(2)
    words = "the of Straße don't I'll naïve x1 42 3.14 foo.bar éà 日本語 Ωmega ... -- <|endoftext|> á".split()
    out = [None, "", " ", "\n", "  two  spaces ", " lead", "trail ", "a\n\nb", "a \nb", "a\n b", "tab\tx", "a\u00a0\n\u00a0y", "é.\u0301 ×; ÷, É!! Ab... (x) 'S's", "ﬁ\u3000x \u2009y", "end\n", "\r\nx", "can't.'s", "nb\u00a0sp", "x\u2003 y", "a \u00a0b", "\u0085x y", "e\u0301 \u0301x", "a\x1c b", "nb sp", "x y", "a\0b", "q" * 5000, "' s'll 's"]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "", "  ", ". "]) for _ in range(rng.randrange(80))))
    return out


@pytest.mark.parametrize("name,spaced", FILES)
def test_pieces_give_the_ids_of_the_whole_text(name, spaced):
    whole = Tokenizer.from_file(tokens.path(name))
    whole.encode_special_tokens = True
    got = tokens.Encoder(tokens.path(name), spaced).encode(pa.array(texts()))
    assert [x.tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts()]


@pytest.mark.parametrize("name,spaced", FILES)
def test_added_tokens_give_the_ids_of_an_unmodified_tokenizer(name, spaced):
    more = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|startoftext|>Ab c", "<|endof", "text|> x", "", None, "<|ENDOFTEXT|> é"]
    whole = Tokenizer.from_file(tokens.path(name))
    got = tokens.Encoder(tokens.path(name), spaced, added=True).encode(pa.array(more + texts()))
    assert [x.tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in more + texts()]


def test_queries_use_the_tokenizer_unmodified(spark, tmp_path):
    rows = [(1, "see <|endoftext|> here"), (2, "plain words"), (3, "<|startoftext|> x <|endoftext|>")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    crc = {}
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        whole = Tokenizer.from_file(tokens.path(file))
        lists = [whole.encode(t, add_special_tokens=False).ids + [1] for _, t in rows]
        crc[file] = [(i, len(x), crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, lists)]
    found = catalog.QUERIES["op8_token_files"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == crc["word_bpe_49k.json"]
    packed = catalog.QUERIES["op1_hilbert_packing"](spark, str(tmp_path)).collect()
    last = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    for pieces in (packed, last):
        assert sorted((r.doc_id, r.length, r.ids_crc32) for r in pieces) == crc["byte_bpe_50k.json"]


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("width", [2048, 16])
def test_round_trip(spark, width):
    rows = list(enumerate(texts())) + [(3, "same"), (3, "same"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, position long, key string").repartition(3)
    pieces = packing.pack(frame, tokens.path("byte_bpe_50k.json"), width=width, with_ids=True)
    found = pieces.collect()
    whole = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    want = sorted(whole.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows)
    line = sorted(found, key=lambda r: (r.sequence, r.offset))
    ends = [(r.sequence * width + r.offset, r.length) for r in line]
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    docs, now = [], []
    for r in line:
        assert r.ids_crc32 == crc32(r.ids) and len(r.ids) == 4 * r.length and r.start == len(now) and r.offset + r.length <= width
        now += np.frombuffer(r.ids, "<u4").tolist()
        if len(now) == r.doc_tokens:
            docs.append(now)
            now = []
    assert sorted(docs) == want and not now
    full = packing.sequences(pieces, width).collect()
    assert all(len(r.ids) == 4 * width for r in full) and sorted(r.filled for r in full)[1:] == [width] * (len(full) - 1)


def test_like_documents_are_neighbours_and_empty_table(spark):
    rng = random.Random(4)
    topics = [["w%d_%d" % (k, j) for j in range(30)] for k in range(6)]
    rows = [(i, " ".join(rng.choice(topics[i % 6]) for _ in range(200))) for i in range(120)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokens.path("byte_bpe_50k.json")).collect()
    order = [r.id % 6 for r in sorted(pieces, key=lambda r: (r.sequence, r.offset)) if r.start == 0]
    same = sum(a == b for a, b in zip(order, order[1:]))
    assert same > 2 * 119 / 6
    first = defaultdict(int)
    for r in pieces:
        first[r.id] += r.length
    assert all(first[r.id] == r.doc_tokens for r in pieces)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokens.path("byte_bpe_50k.json")).count() == 0
