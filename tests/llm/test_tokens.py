"""The pieces that a worker remembers: as few bytes as arrays need, and the same ids whatever was forgotten."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from twinweave.llm import tokens

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def test_a_remembered_piece_takes_few_bytes():
    own = tokens.Encoder(tokens.path("byte_bpe_50k.json"), True)
    texts = [" ".join(f"w{k * 37 % 99991}" for k in range(at, at + 5000)) for at in range(0, 60_000, 5000)]
    own.encode(pa.array(["what the first call loads"]))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for text in texts:
            own.encode(pa.array([text]))
        kept = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert kept < 60_000 * 64


@pytest.mark.parametrize("name,spaced", FILES)
def test_forgotten_pieces_are_encoded_again(name, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 40)
    own, whole = tokens.Encoder(tokens.path(name), spaced), Tokenizer.from_file(tokens.path(name))
    whole.encode_special_tokens = True
    rng = np.random.default_rng(5)
    for _ in range(40):
        texts = [" ".join(f"naïve{k} x," for k in rng.integers(0, 60, rng.integers(1, 25))) for _ in range(3)] + [None, ""]
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in own.encode(pa.array(texts))] == want
