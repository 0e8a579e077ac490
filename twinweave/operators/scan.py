"""Running totals over a whole table without one task seeing the whole table.

Rows carry a unique whole-number id that gives their order. Ids are cut into
blocks of ``block_rows`` consecutive ids, blocks into groups of as many blocks.
Only sums travel upwards: rows are summed per block, blocks per group, and the
few group sums are the only thing a single task ever orders. As ids are unique,
no block can hold more than ``block_rows`` rows however skewed the data is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from twinweave.functions.integers import floor_div

BLOCK_ROWS = 1 << 16

_BEFORE = (W.unboundedPreceding, -1)
_UPTO = (W.unboundedPreceding, 0)


def running_total(
    df: DataFrame,
    amount: Column,
    row_id: str,
    out: str,
    *,
    by: list[str] | None = None,
    exclusive: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` plus ``out`` = sum of ``amount`` over the rows up to and including this one
    (before this one if ``exclusive``) in ``row_id`` order, separately for each ``by`` value."""
    return _running(df, amount, row_id, out, F.sum, lambda x, y: x + y, F.lit(0), by, exclusive, block_rows)


def running_greatest(
    df: DataFrame,
    amount: Column,
    row_id: str,
    out: str,
    *,
    by: list[str] | None = None,
    exclusive: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """As ``running_total`` with the greatest amount so far; nulls are passed over, and before the first amount ``out`` is null."""
    return _running(df, amount, row_id, out, F.max, F.greatest, None, by, exclusive, block_rows)


def _running(df, amount, row_id, out, fold, joined, nothing, by, exclusive, block_rows) -> DataFrame:
    """Any fold whose results per block can be ``joined``; ``nothing`` is its value over no row."""
    by = list(by or [])

    def known(c: Column) -> Column:
        return c if nothing is None else F.coalesce(c, nothing)

    block = floor_div(F.col(row_id).cast("long"), block_rows)
    rows = df.withColumns({"_amount": amount, "_block": block})

    blocks = rows.groupBy(*by, "_block").agg(fold("_amount").alias("_sum"))
    blocks = blocks.withColumn("_group", floor_div(F.col("_block"), block_rows))
    groups = blocks.groupBy(*by, "_group").agg(fold("_sum").alias("_group_sum"))

    over_groups = W.partitionBy(*by).orderBy("_group").rowsBetween(*_BEFORE)
    over_blocks = W.partitionBy(*by, "_group").orderBy("_block").rowsBetween(*_BEFORE)
    group_start = groups.select(*by, "_group", known(fold("_group_sum").over(over_groups)).alias("_group_start"))
    block_start = (
        blocks.withColumn("_in_group", known(fold("_sum").over(over_blocks)))
        .join(group_start, [*by, "_group"])
        .select(*by, "_block", joined(F.col("_group_start"), F.col("_in_group")).alias("_start"))
    )

    over_rows = W.partitionBy(*by, "_block").orderBy(row_id).rowsBetween(*(_BEFORE if exclusive else _UPTO))
    return (
        rows.withColumn("_in_block", known(fold("_amount").over(over_rows)))
        .join(block_start, [*by, "_block"])
        .withColumn(out, joined(F.col("_start"), F.col("_in_block")))
        .select(*df.columns, out)
    )
