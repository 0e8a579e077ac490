"""Heavy hitters of two inputs by mergeable sketches, found in one pass without a shuffle of keys.

Every task sketches the cells of its rows: the most frequent ones of each input, and how many different cells there are. Sketches are merged in two
steps, so no task merges more than about the square root of them. What comes to the driver is one row. The counts a sketch
gives are too high or too low by at most a share of about ``4 / tracked`` of an input's rows, and it names every cell above that.
They steer where rows go, never what is joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from twinweave.model import BALANCE_LIMIT
from twinweave.session import task_slots

#: Sketches that are merged in the first step by one task each.
MERGERS = 64
_MOST_TRACKED = 1 << 20
_MOST_NAMED = 100_000


@dataclass(frozen=True)
class HeavyCell:
    cell: int
    a: float
    b: float
    share: float


def cell_hash(columns: list[Column]) -> Column:
    """A cell's number; null if any of its columns is, as such rows join nothing."""
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.xxhash64(*columns))


def paired_cells(a: DataFrame, b: DataFrame, columns: list[tuple[str, str]]) -> tuple[Column, Column] | None:
    """The cell numbers of the rows of ``a`` and of ``b``, equal wherever the pairs of columns are; None if types differ in a way that
    hashes could not follow."""
    whole = ("tinyint", "smallint", "int", "bigint")
    kinds = dict(a.dtypes), dict(b.dtypes)
    both: tuple[list[Column], list[Column]] = [], []
    for names in columns:
        types = [k[n] for k, n in zip(kinds, names)]
        for out, name, kind in zip(both, names, types):
            c = F.col(f"`{name}`")
            if all(t in whole for t in types):
                c = c.cast("long")
            elif types[0] != types[1]:
                return None
            elif kind in ("float", "double"):
                c = c + F.lit(0.0).cast(kind)  # -0.0 equals 0.0
            out.append(c)
    return cell_hash(both[0]), cell_hash(both[1])


def tracked_for(workers: int) -> int:
    """Cells a sketch keeps, so that a cell of a worker's part of the rows is far above its error."""
    return min(_MOST_TRACKED, 1 << (16 * workers + 1023).bit_length())


def sketched(a: DataFrame, b: DataFrame, workers: int) -> DataFrame:
    """At most one row of statistics over column ``cell`` of both inputs: ``n_a, n_b, cells, top_a, top_b``."""
    tracked = tracked_for(workers)
    named = min(_MOST_NAMED, tracked, 4 * workers + 64)
    both = a.select("cell", F.lit(True).alias("first")).unionByName(b.select("cell", F.lit(False).alias("first"))).where("cell IS NOT NULL")
    per_task = both.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger")).agg(
        F.count_if(F.col("first")).alias("n_a"), F.count_if(~F.col("first")).alias("n_b"), F.hll_sketch_agg("cell").alias("cells"),
        F.expr(f"approx_top_k_accumulate(cell, {tracked}) FILTER (WHERE first)").alias("top_a"),
        F.expr(f"approx_top_k_accumulate(cell, {tracked}) FILTER (WHERE NOT first)").alias("top_b"))
    whole = per_task.groupBy(F.lit(0).alias("all")).agg(  # no row rather than a sketch of nothing
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.hll_sketch_estimate(F.hll_union_agg("cells")).alias("cells"),
        F.expr(f"approx_top_k_combine(top_a, {tracked})").alias("top_a"), F.expr(f"approx_top_k_combine(top_b, {tracked})").alias("top_b"))
    return whole.select("n_a", "n_b", "cells", F.expr(f"approx_top_k_estimate(top_a, {named})").alias("top_a"), F.expr(f"approx_top_k_estimate(top_b, {named})").alias("top_b"))


def heavy_cells(a: DataFrame, b: DataFrame, workers: int, threshold: float = BALANCE_LIMIT, *, pairs: bool) -> list[HeavyCell]:
    """The cells (numbers in column ``cell``) with more than ``threshold / workers`` of all rows or, with ``pairs``, of all candidate pairs.

    One job. A cell that only one sketch names has in the other input what an unnamed cell has there on average.
    """
    if workers < 1 or threshold <= 0:
        raise ValueError("workers and threshold must be positive")
    found = sketched(a, b, workers).first()
    if found is None:
        return []
    top_a, top_b = ({r["item"]: float(r["count"]) for r in found[c] or ()} for c in ("top_a", "top_b"))
    others = max(1.0, float(found["cells"] or 0) - len(top_a.keys() | top_b.keys()))
    rest_a, rest_b = max(0.0, found["n_a"] - sum(top_a.values())), max(0.0, found["n_b"] - sum(top_b.values()))
    counts = {c: (top_a.get(c, rest_a / others), top_b.get(c, rest_b / others)) for c in top_a.keys() | top_b.keys()}
    if pairs:
        load = {c: x * y for c, (x, y) in counts.items()}
        total = sum(load.values()) + rest_a * rest_b / others
    else:
        load = {c: x + y for c, (x, y) in counts.items()}
        total = float(found["n_a"] + found["n_b"])
    if not total:
        return []
    return sorted((HeavyCell(c, *counts[c], load[c] / total) for c in counts if load[c] > total * threshold / workers), key=lambda h: (-h.share, h.cell))


def grid_of(splits: int, a: float, b: float) -> tuple[int, int]:
    """``splits`` tasks as a grid in proportion to the rows of both inputs, so that copies are fewest."""
    for_a = max(1, min(splits, round(sqrt(splits * max(a, 1.0) / max(b, 1.0)))))
    return for_a, ceil(splits / for_a)


def grids(cells: list[HeavyCell], workers: int, threshold: float = BALANCE_LIMIT, max_split: int | None = None) -> list[tuple[int, int, int]]:
    """``cell, splits_a, splits_b`` of the cells that take more than one task each."""
    limit = workers if max_split is None else min(max_split, workers)
    wanted = [(h, min(limit, ceil(h.share * workers / threshold))) for h in cells]
    return [(h.cell, *grid_of(n, h.a, h.b)) for h, n in wanted if n > 1]


def hot_grid(a: DataFrame, b: DataFrame, workers: int | None = None, threshold: float = BALANCE_LIMIT, max_split: int | None = None, *, pairs: bool) -> DataFrame | None:
    """``cell, splits_a, splits_b`` of hot cells as a table to broadcast, None without any.

    Shares add up to one, so there are fewer than ``workers / threshold`` of them.
    """
    spark = a.sparkSession
    workers = workers or task_slots(spark)
    found = grids(heavy_cells(a, b, workers, threshold, pairs=pairs), workers, threshold, max_split)
    return F.broadcast(spark.createDataFrame(found, "cell long, splits_a long, splits_b long")) if found else None
