"""Generated inputs: skewed-key datasets, the random source, round-robin string streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinweave import model
from twinweave.functions import draws, text
from twinweave.functions.integers import as_long, trunc_div
from twinweave.operators.scan import running_total
from twinweave.sources.files import write_synthetic

DISTRIBUTIONS = ("uniform", "zipf", "selfsimilar")


def drawn_keys(u: Column, distribution: str, num_keys: int, skew: float = model.DEFAULT_SKEW, *, zeta_n: float | None = None) -> Column:
    """Key in 1..num_keys for a uniform draw ``u``."""
    if distribution == "uniform":
        return draws.uniform_int(u, 1, num_keys)
    if distribution == "zipf":
        return draws.zipf_int(u, 1, num_keys, skew, zeta_n)
    if distribution == "selfsimilar":
        return draws.self_similar_int(u, 1, num_keys, skew)
    raise ValueError(f"distribution must be one of {', '.join(DISTRIBUTIONS)}")


def dataset_rows(
    rows: DataFrame,
    distribution: str,
    num_keys: int,
    *,
    skew: float = model.DEFAULT_SKEW,
    seed: int = model.SEED_A,
    row_id: str = "row_id",
    key_draw: Column | None = None,
    offset_draw: Column | None = None,
) -> DataFrame:
    """``row_id, key, ts_off`` for every row of ``rows``; draws come from the row id unless given."""
    key_draw = draws.unit_draw(F.col(row_id), seed, 0) if key_draw is None else key_draw
    offset_draw = draws.unit_draw(F.col(row_id), seed, 1) if offset_draw is None else offset_draw
    zeta_n = draws.zeta(rows.sparkSession, num_keys, skew) if distribution == "zipf" else None
    return rows.select(
        F.col(row_id).alias("row_id"),
        drawn_keys(key_draw, distribution, num_keys, skew, zeta_n=zeta_n).alias("key"),
        draws.offset_ms(offset_draw).alias("ts_off"),
    )


def write_dataset(
    spark: SparkSession,
    root: str,
    distribution: str,
    num_keys: int,
    *,
    size: int = model.DEFAULT_ROWS,
    skew: float = model.DEFAULT_SKEW,
    rows: DataFrame | None = None,
    files: int | None = None,
    draws: dict[str, tuple[Column, Column]] | None = None,
) -> str:
    """Write both inputs of a dataset with independent seeds and return the path of the first.

    The folder names carry distribution, number of keys and skew; the inputs are the
    partner folders ``r_rows`` and ``l_rows`` in it. ``rows`` (with ``row_id``) stands in
    for the ids 0..size-1, and ``draws`` gives the columns of ``rows`` that keys and offsets of ``r_rows`` and ``l_rows`` are drawn by instead of the seeds.
    """
    rows = spark.range(size).select(F.col("id").alias("row_id")) if rows is None else rows
    folder = f"{root.rstrip('/')}/dist={distribution}/keys={num_keys}/skew={0.0 if distribution == 'uniform' else skew}"
    for name, seed in (("r_rows", model.SEED_A), ("l_rows", model.SEED_B)):
        key_draw, offset_draw = (draws or {}).get(name, (None, None))
        drawn = dataset_rows(rows, distribution, num_keys, skew=skew, seed=seed, key_draw=key_draw, offset_draw=offset_draw)
        write_synthetic(drawn, f"{folder}/{name}", num_keys, size, files=files)
    return f"{folder}/r_rows"


def key_pmf(spark: SparkSession, num_keys: int, exponent: float = 0.0) -> DataFrame:
    """``key, pmf, cumulative`` of the exact distribution i^-exponent over keys 1..num_keys.

    0 is uniform; any exponent is allowed, unlike in the closed-form draw.
    """
    weights = spark.range(1, num_keys + 1).select(F.col("id").alias("key"), F.pow(F.col("id").cast("double"), F.lit(-exponent)).alias("w"))
    pmf = weights.select("key", (F.col("w") / weights.agg(F.sum("w")).scalar()).alias("pmf"))
    return running_total(pmf, F.col("pmf"), "key", "cumulative")


def cumulative(freq: DataFrame, key: str, n: str = "n", prob: str = "prob") -> DataFrame:
    """``freq`` with ``cumulative``, the share of all rows up to and including each key, in the order of whole-number keys."""
    total = freq.agg(F.sum(n)).scalar()
    counted = running_total(freq, F.col(n), key, "_upto")
    return counted.withColumn("cumulative", F.col("_upto") / total).drop("_upto")


def distribution_check(pmf: DataFrame, freq: DataFrame) -> DataFrame:
    """``pmf`` beside the observed ``n, prob`` of each key (0 where a key was never drawn)."""
    return pmf.join(freq, "key", "left").select(
        "key", "pmf", "cumulative", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("prob", F.lit(0.0)).alias("prob")
    )


def random_source(
    rows: DataFrame,
    num_keys: int,
    *,
    seed: int = model.SEED_A,
    row_id: str = "row_id",
    key_draw: Column | None = None,
    gap_draw: Column | None = None,
    base_ms: int = model.EVENT_TIME_BASE_MS,
) -> DataFrame:
    """``row_id, key, value, event_us`` of the random source: uniform keys 1..num_keys, the first event
    at ``base_ms``, gaps of 0..499 ms after each event."""
    key_draw = draws.unit_draw(F.col(row_id), seed, 0) if key_draw is None else key_draw
    gap_draw = draws.unit_draw(F.col(row_id), seed, 1) if gap_draw is None else gap_draw
    drawn = rows.select(
        F.col(row_id).alias("row_id"),
        draws.uniform_int(key_draw, 1, num_keys).alias("key"),
        as_long(model.CONSTANT_VALUE).alias("value"),
        draws.uniform_int(gap_draw, 0, 499).alias("_gap"),
    )
    timed = running_total(drawn, F.col("_gap"), "row_id", "_before", exclusive=True)
    return timed.select("row_id", "key", "value", ((as_long(base_ms) + F.col("_before")) * as_long(1000)).alias("event_us"))


def round_robin(positions: DataFrame, num_keys: int, *, count: Column, max_ts: Column, position: str = "row_id") -> DataFrame:
    """String stream ``key, value, ts`` over positions 0..count-1: keys in turn, times a fixed step apart.

    ``step`` is ``max(max_ts, count - 1)`` over ``count`` in whole numbers, at least 1. Fails
    unless ``count`` is a multiple of ``num_keys``.
    """
    step = F.greatest(as_long(1), trunc_div(F.greatest(max_ts, count - 1), count))
    i = F.col(position)
    checked = F.when(F.pmod(count, as_long(num_keys)) == 0, i).otherwise(
        F.raise_error(F.lit("the number of rows is no multiple of the number of keys")).cast("long")
    )
    ts = checked * step
    return positions.select(
        text.key_label(F.pmod(i, as_long(num_keys))).alias("key"), ts.cast("string").alias("value"), ts.alias("ts")
    )


def round_robin_range(spark: SparkSession, count: int, num_keys: int, max_ts: int) -> DataFrame:
    positions = spark.range(count).select(F.col("id").alias("row_id"))
    return round_robin(positions, num_keys, count=as_long(count), max_ts=as_long(max_ts))
