"""The rate-limited sampler: per sink, at most ``rate`` values per second of elapsed time.

A value is taken if the number taken so far is at most ``rate * elapsed``. That rule looks
sequential, but the limit only moves in whole steps. All values of a sink between two
steps form a *slot* with limit ``cap``; a slot with n values takes the count from c to
``min(c + n, cap)``. Hence after slot k

    c_k = N_k + min(0, min over j <= k of (cap_j - N_j)),    N_k = n_1 + ... + n_k,

which is a running sum and a running minimum over slots. Rows are only counted per slot,
slots are scanned in blocks, and rows are ranked only inside slots that are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from twinweave.functions.integers import as_long, floor_div
from twinweave.operators.scan import BLOCK_ROWS
from twinweave.operators.skew import salted_lookup
from twinweave.session import durable

_BEFORE = (W.unboundedPreceding, -1)
_UPTO = (W.unboundedPreceding, 0)


def taken_per_slot(slots: DataFrame, sink: str, block_slots: int = BLOCK_ROWS) -> DataFrame:
    """``sink, _cap, _n`` plus ``_take``, the number of values each slot contributes.

    Limits are unique per sink, so a block holds at most ``block_slots`` slots.
    """
    blocked = slots.withColumn("_block", floor_div(F.col("_cap"), block_slots))
    order = W.partitionBy(sink, "_block").orderBy("_cap")
    seen = F.sum("_n").over(order.rowsBetween(*_UPTO))
    local = blocked.withColumn("_seen", seen).withColumn("_room", F.col("_cap") - F.col("_seen"))
    local = local.withColumns({
        "_least": F.min("_room").over(order.rowsBetween(*_UPTO)),
        "_least_before": F.min("_room").over(order.rowsBetween(*_BEFORE)),
    })

    blocks = local.groupBy(sink, "_block").agg(F.max("_seen").alias("_block_n"), F.min("_room").alias("_block_room"))
    over = W.partitionBy(sink).orderBy("_block").rowsBetween(*_BEFORE)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_block_n").over(over), F.lit(0)))
    blocks = blocks.withColumn("_least_blocks", F.min(F.col("_block_room") - F.col("_offset")).over(over))

    def count_after(seen_here: Column, least_here: Column) -> Column:
        least = F.least(F.lit(0), F.col("_least_blocks"), least_here - F.col("_offset"))  # nulls are skipped
        return F.col("_offset") + seen_here + least

    joined = local.join(blocks.select(sink, "_block", "_offset", "_least_blocks"), [sink, "_block"])
    take = count_after(F.col("_seen"), F.col("_least")) - count_after(F.col("_seen") - F.col("_n"), F.col("_least_before"))
    return joined.select(sink, "_cap", "_n", take.alias("_take"))


def rate_sample(
    df: DataFrame,
    *,
    sink: str,
    at: str,
    rate: float,
    epoch: int | Column,
    order: list[str],
    ticks_per_second: int = 1_000_000_000,
    workers: int | None = None,
    taken: int | Column = 0,
) -> DataFrame:
    """The rows of ``df`` the sampler keeps.

    ``taken`` is how many a row's sink has taken before these rows: with it a stream is sampled batch by batch. Then the count starts there, which is the same as
    limits that are lower by as much.

    ``at`` and ``epoch`` count ``ticks_per_second``; ``order`` breaks ties of ``at`` and makes
    the order of a sink's rows total. A rate of 0 or -1 keeps every row.
    """
    if rate in (0, -1):
        return df
    elapsed = (F.col(at) - as_long(epoch)) / F.lit(float(ticks_per_second))
    cap = F.greatest(F.lit(0).cast("long"), F.floor(F.lit(float(rate)) * elapsed) + 1 - as_long(taken))
    rows = df.withColumn("_cap", cap)

    slots = durable(rows.groupBy(sink, "_cap").agg(F.count("*").alias("_n")))
    takes = taken_per_slot(slots, sink).where("_take > 0").withColumnRenamed("_cap", "_slot").withColumnRenamed(sink, "_sink")
    load = slots.select(F.col(sink).alias("_sink"), F.col("_cap").alias("_slot"), F.col("_n").cast("double").alias("load"))
    found = salted_lookup(
        rows.withColumns({"_slot": F.col("_cap"), "_sink": F.col(sink)}), takes, ["_sink", "_slot"],
        [F.col(c) for c in (at, *order)], load, workers=workers,
    )

    # A hot slot is ranked in parts first, and of each part only what could be taken goes on.
    whole = F.col("_n") == F.col("_take")
    by_time = [F.col(c) for c in (at, *order)]
    in_part = F.row_number().over(W.partitionBy("_sink", "_slot", "_salt").orderBy(*by_time))
    in_slot = F.row_number().over(W.partitionBy("_sink", "_slot", F.when(whole, F.col("_salt"))).orderBy(*by_time))
    kept = found.withColumn("_rank", in_part).where(F.col("_rank") <= F.col("_take"))
    kept = kept.withColumn("_rank", in_slot).where(F.col("_rank") <= F.col("_take"))
    return kept.select(*df.columns)
