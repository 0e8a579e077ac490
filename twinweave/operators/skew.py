"""Key statistics and the handling of hot keys.

A join is spread over tasks by its *cell* (the equi-join columns). A hot cell is
split by a grid of ``splits_a`` times ``splits_b`` tasks: a row of the first input gets one
of the ``splits_a`` salts and a copy for each of the other input's, a row of the second
one of ``splits_b`` and a copy for each of the first's. So each pair still meets exactly
once, the input with more rows is divided, and the one with fewer is copied.

Only cells whose share of the load exceeds ``threshold / workers`` are split. Shares
add up to 1, so there are fewer than ``workers / threshold`` such cells: that bound
is what makes it safe to broadcast the table of splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from twinweave.model import BALANCE_LIMIT
from twinweave.session import task_slots

# --- key statistics -------------------------------------------------------------

def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both inputs under each other, copies kept."""
    return a.unionByName(b)


def key_frequency(a: DataFrame, b: DataFrame, key: str, num_keys: int | None = None) -> DataFrame:
    """``key, n, prob`` over both inputs; with ``num_keys`` keys 0..num_keys-1 without rows are kept.

    Each input is counted where it lies; only one partial count per key and task is shuffled.
    """
    counts = bag_union(a.select(key), b.select(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    if num_keys is not None:
        every_key = a.sparkSession.range(num_keys).select(F.col("id").alias(key))
        counts = every_key.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(key, "n", (F.col("n") / total).alias("prob"))


def by_probability(freq: DataFrame, key: str) -> DataFrame:
    """Heaviest key first; equal probabilities in key order."""
    return freq.orderBy(F.desc("prob"), key)


def heaviest(freq: DataFrame, key: str) -> DataFrame:
    """The one most probable key (the smallest of equals)."""
    top = F.min_by(F.struct(key, "n", "prob"), F.struct((-F.col("prob")).alias("p"), F.col(key).alias("k")))
    return freq.agg(top.alias("top")).select("top.*")


def least_loaded(loads: DataFrame) -> DataFrame:
    """The worker with the smallest load (the lowest number of equals)."""
    low = F.min_by(F.struct("worker", "load"), F.struct("load", "worker"))
    return loads.agg(low.alias("low")).select("low.*")


# --- split degrees --------------------------------------------------------------

def split_degree(share: Column, workers: int, threshold: float = BALANCE_LIMIT, max_split: int | None = None) -> Column:
    """Over how many tasks a cell with this share of the load has to be spread so that
    no task gets more than ``threshold`` times the average load."""
    if max_split is not None and max_split < 1:
        raise ValueError("max_split must be at least 1")
    limit = workers if max_split is None else min(max_split, workers)
    return F.least(F.lit(limit), F.greatest(F.lit(1), F.ceil(share * F.lit(workers / threshold)))).cast("long")


def with_splits(freq: DataFrame, workers: int, threshold: float = BALANCE_LIMIT, max_split: int | None = None) -> DataFrame:
    return freq.withColumn("splits", split_degree(F.col("prob"), workers, threshold, max_split))


def split_summary(splits: DataFrame, max_split: int) -> DataFrame:
    """Average and largest split degree, and whether every key reached ``max_split``."""
    return splits.agg(
        F.avg("splits").alias("avg_splits"),
        F.max("splits").alias("max_splits"),
        F.every(F.col("splits") >= F.lit(max_split)).alias("all_max_split"),
    )


def key_load(a: DataFrame, b: DataFrame, cell: list[str]) -> DataFrame:
    """``cell, load, a, b``: rows of both inputs per cell, and of each."""
    return _side_counts(a, b, cell).withColumn("load", F.col("a") + F.col("b"))


def _side_counts(a: DataFrame, b: DataFrame, cell: list[str]) -> DataFrame:
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = bag_union(a.select(*cell, one.alias("a"), none.alias("b")), b.select(*cell, none.alias("a"), one.alias("b")))
    counts = both.dropna("any", subset=cell).groupBy(*cell)
    return counts.agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))


def pair_load(a: DataFrame, b: DataFrame, cell: list[str]) -> DataFrame:
    """``cell, load, a, b``: candidate pairs per cell, and the rows of each input.

    Pairs, not bytes, are the work of a join: 100,000 rows a side are small to
    shuffle and 10 billion pairs to check.
    """
    return _side_counts(a, b, cell).withColumn("load", F.col("a") * F.col("b"))


def grid(splits: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """``splits`` tasks as a grid: both inputs are divided in proportion to their rows, so that copies are fewest."""
    ideal = F.sqrt(splits * F.greatest(a, F.lit(1.0)) / F.greatest(b, F.lit(1.0)))
    split_a = F.greatest(F.lit(1), F.least(splits, F.round(ideal))).cast("long")
    return split_a, F.ceil(splits / split_a).cast("long")


def hot_cells(
    load: DataFrame, cell: list[str], workers: int, threshold: float = BALANCE_LIMIT, max_split: int | None = None
) -> DataFrame | None:
    """``cell, splits`` of the cells with more than ``threshold / workers`` of the load, None if there are none.

    If ``load`` has the rows ``a`` and ``b`` of each input, the grid ``splits_a, splits_b`` is given too.

    Runs a job over the narrow columns of ``cell`` for total and peak, and only if the peak
    is hot a second one that brings back fewer than ``workers / threshold`` rows. So the join
    is planned knowing which cells are hot, and without any salting where none is. The
    numbers steer placement only: any table of splits gives the same joined rows.
    """
    if workers < 1 or threshold <= 0:
        raise ValueError("workers and threshold must be positive")
    whole = load.agg(F.sum("load").alias("total"), F.max("load").alias("peak")).first()
    if not whole["total"] or whole["peak"] <= whole["total"] * threshold / workers:
        return None
    share = F.col("load") / F.lit(whole["total"])
    found = load.withColumn("splits", split_degree(share, workers, threshold, max_split)).where("splits > 1")
    if {"a", "b"} <= set(load.columns):
        for_a, for_b = grid(F.col("splits"), F.col("a"), F.col("b"))
        found = found.select(*cell, "splits", for_a.alias("splits_a"), for_b.alias("splits_b"))
    else:
        found = found.select(*cell, "splits")
    rows = found.collect()
    return F.broadcast(load.sparkSession.createDataFrame(rows, found.schema)) if rows else None


def spread(
    copied: DataFrame,
    salted: DataFrame,
    cell: list[str],
    salt_from: list[Column],
    *,
    hot: DataFrame | None = None,
    splits: int = 1,
    salt: str = "_salt",
) -> tuple[DataFrame, DataFrame]:
    """Both inputs with a ``salt`` column to join on beside ``cell``.

    ``salt_from`` must tell the rows of the salted input apart. It has to be data,
    not a random number: a map task that runs again must choose the same salts.
    """
    if hot is not None:
        copied = copied.join(hot, cell, "left")
        salted = salted.join(hot, cell, "left")
        degree = F.coalesce(F.col("splits"), F.lit(1))
    elif splits > 1:
        degree = F.lit(splits).cast("long")
    else:
        none = F.lit(0).cast("long")
        return copied.withColumn(salt, none), salted.withColumn(salt, none)
    copied = copied.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), degree - 1)))
    salted = salted.withColumn(salt, F.pmod(F.xxhash64(*salt_from), degree))
    return copied.drop("splits"), salted.drop("splits")


def spread_grid(
    left: DataFrame, right: DataFrame, cell: list[str], from_a: list[Column], from_b: list[Column], *, hot: DataFrame | None = None, splits: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Both inputs with salts ``_salt_a`` and ``_salt_b`` to join on beside ``cell``.

    ``hot`` has ``splits_a, splits_b`` of the hot cells; without it every cell gets the squarest grid of ``splits``
    tasks. ``from_a`` and ``from_b`` must tell the rows of an input apart. They have to be data, not random
    numbers: a map task that runs again must choose the same salts.
    """
    if hot is not None:
        table = hot.select(*cell, "splits_a", "splits_b")
        left, right = left.join(table, cell, "left"), right.join(table, cell, "left")
        n_a, n_b = (F.coalesce(F.col(c), F.lit(1)).cast("long") for c in ("splits_a", "splits_b"))
    else:
        n_a, n_b = grid(F.lit(splits).cast("long"), F.lit(1.0), F.lit(1.0))

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    left = left.withColumn("_salt_a", F.pmod(F.xxhash64(*from_a), n_a)).withColumn("_salt_b", every(n_b))
    right = right.withColumn("_salt_b", F.pmod(F.xxhash64(*from_b), n_b)).withColumn("_salt_a", every(n_a))
    return left.drop("splits_a", "splits_b"), right.drop("splits_a", "splits_b")


def salted_lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    salt_from: list[Column],
    load: DataFrame,
    *,
    workers: int | None = None,
    threshold: float = BALANCE_LIMIT,
) -> DataFrame:
    """Inner join of ``rows`` to a table with one row per ``on`` value, hot values split.

    ``load`` has ``on, load``, the rows per value. Keeps the ``_salt`` column: a window
    partitioned by ``on`` and ``_salt`` then needs no further shuffle.
    """
    hot = hot_cells(load, on, workers or task_slots(rows.sparkSession), threshold)
    copied, salted = spread(table, rows, on, salt_from, hot=hot)
    return salted.join(copied, [*on, "_salt"])


# --- load of the workers --------------------------------------------------------

def placement(freq: DataFrame, key: str, workers: int) -> DataFrame:
    """``key, part, worker, load``: each key's parts go to consecutive workers, starting at ``key mod workers``,
    and carry an equal part of its probability. Needs a ``splits`` column."""
    return freq.select(
        key,
        F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("splits"))).alias("part", "_p"),
        (F.col("prob") / F.col("splits")).alias("load"),
    ).select(key, F.col("part").cast("long").alias("part"), F.pmod(F.col(key) + F.col("part"), F.lit(workers).cast("long")).alias("worker"), "load")


def worker_load(placed: DataFrame, workers: int) -> DataFrame:
    """``worker, load`` with every worker 0..workers-1 present."""
    loads = placed.groupBy("worker").agg(F.sum("load").alias("load"))
    every_worker = placed.sparkSession.range(workers).select(F.col("id").alias("worker"))
    return every_worker.join(loads, "worker", "left").select("worker", F.coalesce("load", F.lit(0.0)).alias("load"))


def load_balance(loads: DataFrame) -> DataFrame:
    """Largest load over average load, and whether every worker has some."""
    return loads.agg(
        (F.max("load") / F.avg("load")).alias("balance"),
        (F.min("load") > 0).alias("all_loaded"),
    )


def worker_keys(placed: DataFrame, key: str, workers: int) -> DataFrame:
    """One row per worker and key it may hold, with the worker's load, in worker and key order.

    Long form on purpose: a list of keys per worker would have no size limit.
    """
    loads = worker_load(placed, workers)
    held = placed.select("worker", key).distinct()
    return loads.join(held, "worker", "left").select("worker", F.col("load"), key).orderBy("worker", key)


def measured_load(rows: DataFrame, splits: DataFrame, key: str, row_id: Column, workers: int) -> DataFrame:
    """``worker, load`` counted from the rows themselves under the same placement."""
    # more than one split means more than threshold / workers of the rows: few keys, see the top of this file
    hot = F.broadcast(splits.where(F.col("splits") > 1).select(key, "splits"))
    part = F.pmod(row_id, F.coalesce(F.col("splits"), F.lit(1)))
    counted = (
        rows.join(hot, key, "left")
        .groupBy(F.pmod(F.col(key) + part, F.lit(workers).cast("long")).alias("worker"))
        .agg(F.count("*").cast("double").alias("load"))
    )
    every_worker = rows.sparkSession.range(workers).select(F.col("id").alias("worker"))
    return every_worker.join(counted, "worker", "left").select("worker", F.coalesce("load", F.lit(0.0)).alias("load"))
