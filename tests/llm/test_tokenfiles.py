"""Token files: exact round trips, checkpoints and damage."""

import json
import random
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from twinweave.llm import packing, rans, tokenfiles, tokens


@pytest.mark.parametrize("n,symbols", [(0, 5), (1, 5), (63, 2), (64, 2), (65, 300), (1000, 49408), (300_000, 49408)])
def test_rans_round_trip_from_any_place(n, symbols):
    rng = np.random.default_rng(n)
    data = np.minimum(rng.geometric(.01, n), symbols) - 1
    table = rans.Table.from_bytes(rans.Table.of(np.bincount(data, minlength=symbols)).to_bytes())
    raw = rans.encode(data, table)
    assert (rans.decode(raw, table) == data).all() and rans.size_of(b"xx" + raw, 2) == len(raw)
    for begin, end in [(0, n // 2), (n // 3, n), (n // 2, n // 2 + 1), (n - 1, n), (n, n)]:
        begin = max(begin, 0)
        assert (rans.decode(raw, table, begin, end) == data[begin:end]).all()


def test_one_symbol_and_damage():
    table = rans.Table.of(np.array([0, 9, 0]))
    raw = rans.encode(np.ones(500, int), table)
    assert (rans.decode(raw, table) == 1).all()
    for at in (10, 40, len(raw) - 1):
        with pytest.raises(Exception):
            rans.decode(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:], table)
    with pytest.raises(ValueError):
        rans.encode(np.array([0, 2]), table)
    with pytest.raises(ValueError):
        rans.Table.from_bytes(table.to_bytes()[:-1] + b"\x09")


def test_files_round_trip(spark):
    rng = random.Random(8)
    words = "The of Straße don't 42 日本語 naïve ... x-ray".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in rng.sample(range(-50, 500), 80)]
    rows += [(1000, None), (1001, ""), (1002, "long " * 20_000), (1003, "same"), (1003, "same"), (1003, "other"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    index = tokenfiles.write(frame, tokens.path("word_bpe_49k.json"), block_tokens=500, file_tokens=2000)
    assert index.count() > 5
    got = sorted(tokenfiles.read(index, with_ids=True).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(tokens.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert [(r.id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == want


def test_empty_table(spark):
    index = tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), tokens.path("word_bpe_49k.json"))
    assert index.count() == 0 and tokenfiles.read(index).count() == 0


def test_vocabularies_beyond_16_bits(spark, tmp_path):
    """A word list of 70,000 entries, made by hand: its ids take 32 bits, in token files and in packed sequences."""
    file = tmp_path / "words.json"
    file.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"},
                                "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {f"w{k}": k for k in range(70_000)}, "unk_token": "w0"}}))
    docs = spark.createDataFrame([(k, f"w{69_999 - k} w{k} w65536 w65535") for k in range(30)], "doc_id long, text string")
    ids = {k: [69_999 - k, k, 65_536, 65_535, 1] for k in range(30)}
    got = tokenfiles.read(tokenfiles.write(docs, str(file), spaced=False)).collect()
    assert {r.id: r.ids_crc32 for r in got} == {k: crc32(np.array(v, "<u4").tobytes()) for k, v in ids.items()}
    pieces = packing.pack(docs, str(file), spaced=False, width=64, with_ids=True).collect()
    by = {}
    for p in sorted(pieces, key=lambda p: p.start):
        by[p.id] = by.get(p.id, b"") + p.ids
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in by.items()} == ids
