"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut in windows of ``STEPS`` bytes. In each window one network reads forwards and one backwards; the two states at a position give the
probability of each language there, and a document's probability is the mean over all of its bytes. Thousands of windows are
stepped at once as numpy arrays. Training is backpropagation through time with Adam, in numpy on the driver, from a sample of at most about
``SAMPLE_DOCS`` documents per language and ``SAMPLE_WINDOWS`` windows of each; the model is some ten kilobytes and is broadcast.

Defined cases: ``und`` with score 0 for a null or empty text or one without any letter, and if there was nothing to learn from; equal texts
get equal predictions; a null id is never learned from; ties go to the first language in order; repeated rows are learned from once; of more than
``MOST_LABELS`` languages the most frequent are learned; an empty table has an empty result; very long texts are read whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from twinweave.llm.sample import bounded
from twinweave.llm.words import flat, slices

STEPS = 64
UNITS = 12
LANES = 4096
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 12
SAMPLE_BYTES = 1 << 16  # longer texts are not learned from
ROUNDS = 260
BATCH = 512
UNKNOWN = "und"


class Direction:
    """One network; gates are ``(1 + tanh) / 2``."""

    def __init__(self, rng: np.random.Generator, units: int):
        self.embed = [rng.normal(0, .3, (256, units)).astype(np.float32) for _ in range(3)]
        self.recur = [(rng.normal(0, 1, (units, units)) / np.sqrt(units)).astype(np.float32) for _ in range(3)]

    @property
    def parts(self) -> list[np.ndarray]:
        return self.embed + self.recur

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step for bytes ``x`` (steps by lanes); with ``keep`` what the way back needs."""
        steps, lanes = x.shape
        h = np.zeros((lanes, self.recur[0].shape[0]), np.float32)
        out, tape = np.empty((steps, *h.shape), np.float32), []
        z, r, c, m = (np.empty_like(h) for _ in range(4))
        for t in range(steps):
            for gate, embed in zip((z, r, c), self.embed):
                np.take(embed, x[t], axis=0, out=gate, mode="clip")
            for gate, recur in ((z, self.recur[0]), (r, self.recur[1])):
                np.matmul(h, recur, out=m)
                gate += m
                np.tanh(gate, out=gate)
                gate *= .5
                gate += .5
            if keep:
                tape.append((h, z.copy(), r.copy()))
            r *= h
            np.matmul(r, self.recur[2], out=m)
            c += m
            np.tanh(c, out=c)
            if keep:
                tape[-1] += (c.copy(),)
            np.subtract(c, h, out=m)
            m *= z
            np.add(h, m, out=out[t])
            h = out[t]
        return out, tape

    def back(self, x: np.ndarray, tape: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of ``parts`` from those of the states."""
        recur = [np.zeros_like(u) for u in self.recur]
        gates = [np.empty_like(grad) for _ in range(3)]
        g = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            g = g + grad[t]
            h, z, r, c = tape[t]
            dc = g * z * (1 - c * c)
            dz = g * (c - h) * 2 * z * (1 - z)
            drh = dc @ self.recur[2].T
            dr = drh * h * 2 * r * (1 - r)
            recur[0] += h.T @ dz
            recur[1] += h.T @ dr
            recur[2] += (r * h).T @ dc
            g = g * (1 - z) + drh * r + dz @ self.recur[0].T + dr @ self.recur[1].T
            for gate, value in zip(gates, (dz, dr, dc)):
                gate[t] = value
        flat_x = x.ravel()
        embed = [np.stack([np.bincount(flat_x, d, 256) for d in gate.reshape(-1, gate.shape[2]).T], 1).astype(np.float32) for gate in gates]
        return embed + recur


class Network:
    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.behind = Direction(rng, units), Direction(rng, units)
        self.top = (rng.normal(0, 1, (2 * units, len(labels))) / np.sqrt(2 * units)).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    @property
    def parts(self) -> list[np.ndarray]:
        return [*self.ahead.parts, *self.behind.parts, self.top, self.bias]

    def states(self, x: np.ndarray, keep: bool = False):
        first, tape_1 = self.ahead.run(x, keep)
        second, tape_2 = self.behind.run(np.ascontiguousarray(x[::-1]), keep)
        return first, second[::-1], tape_1, tape_2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each label at each position: steps by lanes by labels."""
        first, second, _, _ = self.states(x)
        units = first.shape[2]
        out = first @ self.top[:units]
        out += second @ self.top[units:]
        out += self.bias
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def learn(self, x: np.ndarray, inside: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of ``parts`` for windows (steps by lanes), their real bytes and the label of each lane."""
        first, second, tape_1, tape_2 = self.states(x, keep=True)
        both = np.concatenate([first, second], axis=2)
        logits = both @ self.top + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        weight = inside / inside.sum()
        lanes = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, lanes, label] + 1e-9) * weight).sum())
        p[:, lanes, label] -= 1
        p *= weight[:, :, None]
        p = p.astype(np.float32)
        units = first.shape[2]
        spread = p @ self.top.T
        grads = self.ahead.back(x, tape_1, spread[:, :, :units])
        grads += self.behind.back(np.ascontiguousarray(x[::-1]), tape_2, np.ascontiguousarray(spread[::-1, :, units:]))
        return loss, [*grads, np.einsum("tnu,tnk->uk", both, p, optimize=True), p.sum(axis=(0, 1))]


def windows(data: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (windows by steps), how many real bytes each has, and the row it is of."""
    sizes = np.diff(offsets)
    count = -(-sizes // steps)
    row = np.repeat(np.arange(len(sizes)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + inner * steps
    real = np.minimum(steps, offsets[row + 1] - start)
    at = start[:, None] + np.arange(steps)
    padded = np.append(data, np.zeros(steps, np.uint8))
    x = padded[np.minimum(at, len(data))]
    x[np.arange(steps) >= real[:, None]] = 0
    return x, real, row


def fit(texts: list[bytes], labels: list[str], seed: int = 1, rounds: int = ROUNDS, per_doc: int = SAMPLE_WINDOWS) -> Network | None:
    """A network trained on some windows of each text; None without a text."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, real, row = windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    shuffled = rng.permutation(len(row))
    shuffled = shuffled[np.argsort(row[shuffled], kind="stable")]
    rank = np.arange(len(row)) - np.searchsorted(row[shuffled], row[shuffled])
    chosen = shuffled[rank < per_doc]
    x, real, label = x[chosen], real[chosen], np.array([names.index(v) for v in labels])[row[chosen]]
    net = Network(names, seed=seed)
    if not len(x):
        return net
    groups = [np.flatnonzero(label == k) for k in range(len(names))]
    groups = [g for g in groups if len(g)]
    mean, square = ([np.zeros_like(p) for p in net.parts] for _ in range(2))
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
        own = np.ascontiguousarray(x[pick].T.astype(np.intp))
        _, grads = net.learn(own, (np.arange(STEPS)[:, None] < real[pick]).astype(np.float32), label[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = .02 * min(1, step / 10) * (1 - .9 * step / rounds)
        for p, g, m, s in zip(net.parts, grads, mean, square):
            g = g * min(1, 1 / (norm + 1e-9))
            m += .1 * (g - m)
            s += .01 * (g * g - s)
            p -= rate * (m / (1 - .9 ** step)) / (np.sqrt(s / (1 - .99 ** step)) + 1e-7)
    return net


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability of each label over all bytes of each text."""
    x, real, row = windows(data, offsets)
    total = np.zeros((len(offsets) - 1, len(net.labels)))
    for at in range(0, len(row), LANES):
        own = np.ascontiguousarray(x[at:at + LANES].T.astype(np.intp))
        p = net.probabilities(own)
        p *= (np.arange(STEPS)[:, None] < real[at:at + LANES])[:, :, None]
        sums = p.sum(axis=0)
        for k in range(len(net.labels)):
            total[:, k] += np.bincount(row[at:at + LANES], sums[:, k], len(total))
    return total / np.maximum(1, np.diff(offsets))[:, None]


def labelled(net: Network, text: str) -> list[tuple[str, float]]:
    """Label and probability of every byte of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    x, real, _ = windows(raw, np.array([0, len(raw)]))
    p = net.probabilities(np.ascontiguousarray(x.T.astype(np.intp)))
    best = p.argmax(axis=2).T
    return [(net.labels[best[w, t]], float(p[t, w, best[w, t]])) for w in range(len(x)) for t in range(real[w])]


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = model.value
        for part in slices(batches, size=1 << 20):
            p = score(net, *flat(part.column("text")))
            best = p.argmax(axis=1)
            arrays = [pa.array([net.labels[k] for k in best], pa.string()), pa.array(np.minimum(1.0, p[np.arange(len(best)), best]))]
            kept = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + arrays, names=kept + ["lang_pred", "score"])
    return run


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """Documents that are never learned from; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def train(docs: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_DOCS) -> Network | None:
    rows = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.octet_length(text) <= SAMPLE_BYTES)).select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    found = sorted(bounded(rows, "lang", ["id", "text"], most).collect(), key=lambda r: (r["lang"], r["id"], r["text"]))
    return fit([r["text"].encode() for r in found], [r["lang"] for r in found])


def predict(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text_key, lang_pred, score`` of every whole text."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("known"), F.col(text).alias("text"))
    if net is None:
        return rows.select("id", "text_key", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = f"id {docs.schema[doc_id].dataType.simpleString()}, text_key long, known boolean, lang_pred string, score double"
    out = rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(net)), kind)
    return out.select("id", "text_key", F.when(F.col("known"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(F.col("known"), F.col("score")).otherwise(0.0).alias("score"))


def _known(model, least: float, names: list[str]):
    """Rows of the columns ``c0, c1, ...``, which stand for ``names``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = model.value
        text, lang = (f"c{names.index(n)}" for n in ("text", "lang"))
        for part in slices(batches, text, size=1 << 20):
            if net is None:
                yield part
                continue
            p = score(net, *flat(part.column(text)))
            best = pa.array([net.labels[k] for k in p.argmax(axis=1)], pa.string())
            at = part.schema.get_field_index(lang)
            part = part.set_column(at, part.schema.field(at), pc.coalesce(part.column(lang), best))
            yield part.filter(pa.array(p.max(axis=1) >= least))
    return run


def keep_known(docs: DataFrame, net: Network | None, least: float = 0.4) -> DataFrame:
    """The documents with a letter whose language has a probability of at least ``least``. A null ``lang`` becomes the predicted one; all other
    columns stay as they are. Without a network the lettered documents stay as they are.

    With four languages one always has a quarter, so the bound only rejects texts that look like no language that was learned.
    """
    names = docs.columns
    own = [F.col(f"`{c}`").cast("string") if c == "lang" else F.col(f"`{c}`") for c in names]
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).select(*[c.alias(f"c{k}") for k, c in enumerate(own)])
    kept = lettered.mapInArrow(_known(docs.sparkSession.sparkContext.broadcast(net), least, names), lettered.schema)
    return kept.select(*[F.col(f"c{k}").cast(docs.schema[c].dataType).alias(c) for k, c in enumerate(names)])
