"""Chat formatting: role repair of least cost, then rendering.

A legal conversation is a path of the automaton ``start -> system? -> user -> assistant -> user ...`` that ends in an accepted role. Every turn gets a role:
its own, or another for the cost of a relabel. A turn may follow one of its own role (both are merged), and where no
step is legal, empty turns are inserted. Costs are whole numbers; dynamic programming over the four states finds the least sum.

A conversation may have any number of turns. Turns are range-sorted by conversation and turn, so a long conversation spreads over
many tasks, and cut in segments of ``SEGMENT`` turns. The costs from each state to each other through a segment form a 4 x 4 table, and such tables multiply
(least sum). Only the tables of a conversation's segments meet in one task; that fixes the state at every cut, and then each segment is
repaired by itself between its two states. Results are a row per turn, so no row holds a conversation.

Defined cases: null role or one that is none of the three costs ``unknown`` whatever it becomes; null text is empty; turns are taken in order of turn (null
first), then role and text, so repeated rows and ties follow each other; a null conversation id is a conversation; markers in texts are
broken up, so that no text can end its turn. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from twinweave.session import durable

ROLES = ("system", "user", "assistant")  # states 1, 2, 3; 0 is the start
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
SEGMENT = 10_000
_FAR = 1 << 40
TURNS = "conv_id long, turn long, part long, seg long, at long, role string, new_role string, action string, inserted array<string>, cost long, rendered string"


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 6
    relabel_system: int = 9  # to or from system
    insert: int = 5
    unknown: int = 1
    accept: tuple[str, ...] = ("user", "assistant")


def _way(a: int, ends: tuple[int, ...]) -> tuple[int, ...] | None:
    """States to be inserted between ``a`` and the first of ``ends`` that is reached."""
    seen, ways = {a}, [(a, ())]
    while ways:
        grown = []
        for s, way in ways:
            for q in _NEXT[s]:
                if q in ends:
                    return way
                if q not in seen:
                    seen.add(q)
                    grown.append((q, (*way, q)))
        ways = grown
    return None


class Automaton:
    """Costs and actions of each step: from a state, with a turn of a given role, to a state."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.steps = {r: np.full((4, 4), _FAR, np.int64) for r in range(4)}  # by role, 0 is unknown
        self.inserted: dict[tuple[int, int], tuple[int, ...]] = {}
        self.merged = np.zeros((4, 4), bool)
        for s in range(4):
            for q in (1, 2, 3):
                way = _way(s, (q,))
                price = _FAR if way is None else costs.insert * len(way)
                if s == q and costs.merge <= price:
                    self.merged[s, q], price, way = True, costs.merge, ()
                if price >= _FAR:
                    continue
                self.inserted[s, q] = way
                for r in range(4):
                    change = 0 if r == q else costs.unknown if r == 0 else costs.relabel_system if 1 in (r, q) else costs.relabel
                    self.steps[r][s, q] = price + change
        accepted = tuple(ROLES.index(a) + 1 for a in costs.accept)
        self.ends: dict[int, tuple[int, ...] | None] = {}  # empty turns after the last state
        for s in (1, 2, 3):
            ways = [(*way, e) for e in accepted if (way := _way(s, (e,))) is not None]
            self.ends[s] = () if s in accepted else min(ways, key=len, default=None)

    def through(self, roles: list[int]) -> np.ndarray:
        """Least costs from each state to each through some turns."""
        table = np.where(np.eye(4, dtype=bool), 0, _FAR)
        for r in roles:
            table = np.minimum((table[:, :, None] + self.steps[r][None]).min(axis=1), _FAR)
        return table

    def path(self, roles: list[int], first: int, last: int) -> list[int]:
        """States after each turn on a way of least cost from ``first`` to ``last``; of equals the earlier state."""
        cost = np.full(4, _FAR, np.int64)
        cost[first] = 0
        back = []
        for r in roles:
            ways = cost[:, None] + self.steps[r]
            back.append(ways.argmin(axis=0))
            cost = np.minimum(ways.min(axis=0), _FAR)
        out = [last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1][1:]

    def cuts(self, tables: list[np.ndarray]) -> list[int]:
        """States before the first segment, between segments and after the last one."""
        cost, back = np.array([0, _FAR, _FAR, _FAR], np.int64), []
        for t in tables:
            ways = cost[:, None] + t
            back.append(ways.argmin(axis=0))
            cost = np.minimum(ways.min(axis=0), _FAR)
        final = [cost[s] + self.costs.insert * len(self.ends[s]) if s and self.ends[s] is not None else _FAR for s in range(4)]
        out = [int(np.argmin(final))]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def _code(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def _segmented(costs: Costs, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seg, before, held = Automaton(costs), TaskContext.get().partitionId(), -1, object(), 0
        table = None
        waiting: pa.RecordBatch | None = None

        def closed(batch: pa.RecordBatch, tables: list) -> pa.RecordBatch:
            return batch.append_column("table", pa.array(tables, pa.list_(pa.int64())))

        tables: list = []
        for batch in batches:
            convs, roles = batch.column("conv_id").to_pylist(), [_code(r) for r in batch.column("role").to_pylist()]
            segs, ats, ends = [], [], []
            for k, (conv, r) in enumerate(zip(convs, roles)):
                if conv != before or held == segment:
                    if k:
                        ends[-1] = table.ravel().tolist()
                    elif waiting is not None:
                        tables[-1] = table.ravel().tolist()
                    seg, before, held, table = seg + 1, conv, 0, own.through([])
                table = np.minimum((table[:, :, None] + own.steps[r][None]).min(axis=1), _FAR)
                segs.append(seg)
                ats.append(held)
                ends.append(None)
                held += 1
            if waiting is not None and convs:
                yield closed(waiting, tables)
            if convs:
                n = len(convs)
                waiting, tables = batch.append_column("part", pa.array([part] * n, pa.int64())).append_column("seg", pa.array(segs, pa.int64())).append_column("at", pa.array(ats, pa.int64())), ends
        if waiting is not None:
            tables[-1] = table.ravel().tolist()
            yield closed(waiting, tables)
    return run


def _joined(costs: Costs):
    """States at the cuts of every conversation; its segments come in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Automaton(costs)
        held: list[tuple] = []

        def solved() -> pa.RecordBatch:
            states = own.cuts([np.array(r[3]).reshape(4, 4) for r in held])
            n = len(held)
            return pa.RecordBatch.from_arrays([
                pa.array([r[1] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.int64()), pa.array(states[:-1], pa.int64()),
                pa.array(states[1:], pa.int64()), pa.array([k == n - 1 for k in range(n)])], names=["c_part", "c_seg", "first", "last", "final"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "seg", "table"))):
                if held and held[-1][0] != row[0]:
                    yield solved()
                    held = []
                held.append(row)
        if held:
            yield solved()
    return run


def _repaired(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Automaton(costs)
        held: list[dict] = []

        def solved() -> pa.RecordBatch:
            roles = [_code(r["role"]) for r in held]
            s, end, final = held[0]["first"], held[0]["last"], held[0]["final"]
            rows = []
            for k, (r, q) in enumerate(zip(roles, own.path(roles, s, end))):
                way, merged = own.inserted[s, q], bool(own.merged[s, q])
                after = own.ends[q] if final and k == len(roles) - 1 else None
                cost = int(own.steps[r][s, q]) + costs.insert * len(after or ())
                text = (held[k]["text"] or "").replace("<|", "< |")
                if merged:
                    shown = "\n\n" + text
                else:
                    heads = "<|end|>\n".join(f"<|{ROLES[x - 1]}|>\n" for x in (*way, q))
                    shown = ("<|end|>\n" if s else "") + heads + text
                if after is not None:
                    shown += "<|end|>\n" + "".join(f"<|{ROLES[x - 1]}|>\n<|end|>\n" for x in after)
                action = "+".join((["relabel"] if r != q else []) + (["merge"] if merged else [])) or "keep"
                rows.append({**{c: held[k][c] for c in ("conv_id", "turn", "part", "seg", "at", "role")}, "new_role": ROLES[q - 1], "action": action,
                             "inserted": [ROLES[x - 1] for x in (*way, *(after or ()))], "cost": cost, "rendered": shown})
                s = q
            kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "part": pa.int64(), "seg": pa.int64(), "at": pa.int64(), "cost": pa.int64(), "inserted": pa.list_(pa.string())}
            names = [c.split()[0] for c in TURNS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[-1]["part"], held[-1]["seg"]) != (row["part"], row["seg"]):
                    yield solved()
                    held = []
                held.append(row)
        if held:
            yield solved()
    return run


def repair(turns: DataFrame, costs: Costs = Costs(), segment: int = SEGMENT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn, ``TURNS``: its new role, what was done (``keep``, ``relabel``, ``merge``), empty turns inserted before it (after it, if it is the
    last), and its part of the rendered conversation. ``part, seg, at`` give the order of turns."""
    if segment < 1:
        raise ValueError("a segment has at least one turn")
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    # the text is a sort key in tasks only; turns that are equal but for it go to the same range
    kind = "conv_id long, turn long, role string, text string, part long, seg long, at long, table array<long>"
    sorted_rows = durable(rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions(*order).mapInArrow(_segmented(costs, segment), kind))
    tables = sorted_rows.where("table is not null").select("conv_id", "part", "seg", "table")
    cuts = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(
        _joined(costs), "c_part long, c_seg long, first long, last long, final boolean")
    joined = sorted_rows.drop("table").join(cuts, (F.col("part") == F.col("c_part")) & (F.col("seg") == F.col("c_seg")))
    return joined.repartition("part", "seg").sortWithinPartitions("part", "seg", "at").mapInArrow(_repaired(costs), TURNS)


def rendered(repaired: DataFrame) -> DataFrame:
    """``conv_id, text``: whole conversations, for those that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("part", "seg", "at", "rendered")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("text"))
