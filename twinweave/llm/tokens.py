"""Token ids of whole texts by a tokenizer file, each distinct piece encoded once.

The pre-tokenizers of the public files always cut at a single space or line feed, and between a letter and punctuation that is no
apostrophe, so the ids of a text are the ids of its pieces between such places, one after the other. Pieces repeat: those of a slice of
texts are numbered by their 64-bit hashes, only distinct ones are looked up, and only unknown ones go to the tokenizer. A text in which
cutting is not certain (runs of white space or rare white space, where a tokenizer keeps it) is encoded as a whole.

With ``added`` the tokenizer is used as its library loads it: an added token such as ``<|endoftext|>`` that stands in a text is one id, and a
text that contains one is encoded as a whole. Without, its characters are text like others. The registered queries set ``added``.
``encode`` gives what the tokenizer gives for the whole text, which the tests check.
"""

from __future__ import annotations

import os
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from twinweave.llm.words import Words, flat, mixed

#: Id that ends each document.
END = 1
#: Pieces in one of the two generations a Python worker remembers. This bounds memory and nothing else.
CACHED = 400_000
#: Bytes of text encoded at a time: a worker keeps the memory of its largest step while it serves other tasks.
ENCODED_BYTES = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in b".,;:!?%*#$&|()[]{}\"-+=/<>@_~^\\`"]] = True
#: Bytes that are, or begin or end, white space other than space and line feed.
_RARE = np.zeros(256, bool)
_RARE[[*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20)]] = True


def path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    return public_tokenizers.path(name)


def _rare_spaces(data: np.ndarray) -> np.ndarray:
    """Bytes at which white space other than space and line feed begins."""
    out = _RARE[data]
    if (data >= 0xC2).any():
        second, third = np.append(data[1:], 0), np.append(data[2:], [0, 0])[:len(data)]
        out |= (data == 0xC2) & ((second == 0x85) | (second == 0xA0))
        out |= (data == 0xE1) & (second == 0x9A) | (data == 0xE3) & (second == 0x80) & (third == 0x80)
        out |= (data == 0xE2) & ((second == 0x80) & ((third <= 0x8A) | (third >= 0xA8) & (third <= 0xAF)) | (second == 0x81))
    return out


@dataclass
class Pieces:
    """Ids of known pieces in four arrays, some 30 bytes for a piece: ``ids[starts[k]:starts[k] + sizes[k]]`` are those of ``keys[k]``; keys ascend."""

    keys: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls) -> Pieces:
        return cls.of(np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint32))

    @classmethod
    def of(cls, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Pieces:
        """From ids that lie in the order of ``keys``, whatever that is."""
        order = np.argsort(keys)
        return cls(keys[order], (np.cumsum(sizes, dtype=np.int64) - sizes)[order], sizes[order], ids)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for an unknown one."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def taken(self, places: np.ndarray) -> Pieces:
        sizes = self.sizes[places]
        ends = np.cumsum(sizes, dtype=np.int64)
        inner = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[places] - ends + sizes, sizes)
        return Pieces.of(self.keys[places], sizes, self.ids[inner])

    def joined(self, other: Pieces) -> Pieces:
        """These and others, of which no key is among these."""
        if not len(other.keys):
            return self
        at = np.searchsorted(self.keys, other.keys)
        return Pieces(np.insert(self.keys, at, other.keys), np.insert(self.starts, at, other.starts + len(self.ids)),
                      np.insert(self.sizes, at, other.sizes), np.concatenate([self.ids, other.ids]))


class Encoder:
    """``spaced``: the tokenizer keeps a space in front of a word (byte level); else it drops white space. ``added``: added tokens in a text
    are one id each."""

    def __init__(self, file: str, spaced: bool, added: bool = False):
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.spaced = spaced
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.young, self.old = Pieces.none(), Pieces.none()

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, whether a space goes before each, and which texts must not be cut."""
        space, line = data == 0x20, data == 0x0A
        gap = space | line
        rows = len(offsets) - 1
        whole = np.zeros(rows, bool)
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        head = head[:-1]
        begin = ~gap
        begin[1:] &= gap[:-1] | head[1:]
        # a letter (also one of Latin-1 in two bytes), then punctuation
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begin[1:] |= letter[:-1] & _PUNCTUATION[data[1:]] & ~gap[:-1]
        lead = np.zeros(len(data), bool)
        if self.spaced:
            lead[1:] = space[:-1] & ~head[1:]
            begin |= line
            doubt = gap.copy()  # white space at either end of a text or next to other white space
            doubt[:-1] &= gap[1:] | head[1:]
            edge = gap & head
            for found in (np.flatnonzero(doubt), np.flatnonzero(edge), np.flatnonzero(_rare_spaces(data))):
                whole[np.searchsorted(offsets, found, side="right") - 1] = True
        # a piece ends at the next piece, gap or text
        stops = np.flatnonzero(np.append(begin | gap | head, True))
        own = np.flatnonzero(begin[stops[:-1]])
        starts, ends = stops[own], stops[own + 1]
        return starts, ends, lead[starts], whole

    def _mark_added(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> None:
        """Texts with an added token must not be cut."""
        raw = data.tobytes() if self.added else b""
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                whole[row] = True
                at = raw.find(token, int(offsets[row + 1]))

    def _ids(self, keys: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct keys begin, how many they are, and all ids; ``text_of(k)`` gives the text of the k-th."""
        if len(self.young.keys) > CACHED:
            self.old, self.young = self.young, Pieces.none()
        new = np.flatnonzero(self.young.places(keys) < 0)
        at = self.old.places(keys[new])
        again, new = at[at >= 0], new[at < 0]
        self.young = self.young.joined(self.old.taken(again))
        own, sizes = array("I"), []
        for k in range(0, len(new), 4096):
            for coded in self.tokenizer.encode_batch_fast([text_of(j) for j in new[k:k + 4096].tolist()], add_special_tokens=False):
                ids = coded.ids
                own.extend(ids)
                sizes.append(len(ids))
        self.young = self.young.joined(Pieces.of(keys[new], np.array(sizes, np.int32), np.array(own, np.uint32)))
        at = self.young.places(keys)
        return self.young.starts[at], self.young.sizes[at], self.young.ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        data, offsets = flat(texts)
        if not len(data):
            return [np.empty(0, np.uint32)] * len(texts)
        starts, ends, lead, whole = self._cut(data, offsets)
        self._mark_added(data, offsets, whole)
        words = Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))
        hashes = words.hashes()
        hashes[lead] = mixed(hashes[lead] ^ np.uint64(0x5851F42D4C957F2D))
        numbered = pa.array(hashes).dictionary_encode()
        index, keys = numbered.indices.to_numpy(), numbered.dictionary.to_numpy()
        first = np.empty(len(keys), np.int64)
        first[index[::-1]] = np.arange(len(index) - 1, -1, -1)

        def text_of(k: int) -> str:
            j = first[k]
            return (" " if lead[j] else "") + data[starts[j]:ends[j]].tobytes().decode()

        base, sizes, table = self._ids(keys, text_of)
        count = sizes[index].astype(np.int64)
        last = np.cumsum(count)
        ids = table[np.repeat(base[index] - last + count, count) + np.arange(int(last[-1]) if len(last) else 0)]
        bounds = np.concatenate([[0], last])[words.first]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        again = np.flatnonzero(whole)
        if again.size:
            coded = self.tokenizer.encode_batch_fast([texts[int(r)].as_py() or "" for r in again], add_special_tokens=False)
            for r, c in zip(again, coded):
                out[r] = np.array(c.ids, np.uint32)
        return out


@lru_cache(maxsize=4)
def encoder(file: str, spaced: bool, added: bool = False) -> Encoder:
    """One per Python worker, file and use of added tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(file, spaced, added)
