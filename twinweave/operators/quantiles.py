"""Exact percentiles under the two rank rules of the result files.

``truncated``: the element at 0-based place ``trunc(n * p)`` of the sorted values.
``interpolated``: 1-based place ``p * (n + 1)``, between two neighbours by its fraction.
Spark's own ``percentile`` uses a third rule and holds all distinct values of a group in one task.

A quantile sketch per group brackets every wanted place between two values. A second scan counts what lies between the brackets
as a whole and only the values inside one by one, so that of a large group some ten thousandths are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from twinweave.model import PERCENTILES
from twinweave.session import durable

#: The sketch's places are wrong by at most one in this many.
ACCURACY = 10_000
#: Groups up to this size are ordered whole; beyond it, a bracket is wider than what rank rules and sketch can differ by.
SMALL = 2 * ACCURACY
#: Distinct values that one task orders.
BLOCK_VALUES = 1 << 18


def _places(n: Column, probs: Sequence[float], method: str) -> Column:
    """Array of ``prob, at, next, part``: the value is ``x[at] + part * (x[next] - x[at])``."""
    last = n - 1
    places = []
    for p in probs:
        if method == "truncated":
            at = F.least(F.floor(n.cast("double") * F.lit(p)), last)
            nxt, part = at, F.lit(0.0)
        elif method == "interpolated":
            pos = F.lit(round(p * 100, 9)) * (n + 1).cast("double") / F.lit(100.0)
            inside = (pos >= 1) & (pos < n)
            at = F.when(inside, F.floor(pos) - 1).when(pos < 1, F.lit(0)).otherwise(last)
            nxt = F.when(inside, F.floor(pos)).otherwise(at)
            part = F.when(inside, pos - F.floor(pos)).otherwise(F.lit(0.0))
        else:
            raise ValueError("method must be truncated or interpolated")
        places.append(F.struct(F.lit(float(p)).alias("prob"), at.cast("long").alias("at"), nxt.cast("long").alias("next"), part.alias("part")))
    return F.array(*places)


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equal group columns, null groups included."""
    out = F.lit(True)
    for x, y in zip(left, right):
        out = out & x.eqNullSafe(y)
    return out


def group_statistics(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``by..., samples, mean, low, high, cuts`` in one pass: moments, and values below and above every wanted place."""
    reach = 2.0 / ACCURACY
    cuts = [max(0.0, p - reach) for p in probs] + [min(1.0, p + reach) for p in probs]
    v = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("samples"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.percentile_approx(v, cuts, ACCURACY).alias("cuts"))


def _counted(df: DataFrame, value: str, stats: DataFrame, by: Sequence[str], n: int, small: int) -> DataFrame:
    """``by..., _v, _gap, _n``: values inside a bracket one by one, what lies between two brackets as one row behind the lower one."""
    names = [f"_g{k}" for k in range(len(by))]
    limits = stats.select(*[F.col(b).alias(g) for b, g in zip(by, names)], F.col("samples").alias("_all"), F.col("cuts").alias("_cuts"))
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if by:
        rows = rows.join(limits, same([F.col(b) for b in by], [F.col(g) for g in names]))
    else:
        rows = rows.withColumns({c: limits.select(c).scalar() for c in ("_all", "_cuts")})
    v, low, high = F.col("_v"), [F.col("_cuts")[j] for j in range(n)], [F.col("_cuts")[n + j] for j in range(n)]
    inside = F.col("_all") <= small
    for a, b in zip(low, high):
        inside = inside | v.between(a, b)
    below = [F.when(b < v, b) for b in high]
    place = F.when(inside, v).otherwise(F.greatest(*below) if n > 1 else below[0])
    return rows.select(*by, place.alias("_v"), (~inside).alias("_gap")).groupBy(*by, "_v", "_gap").agg(F.count("*").alias("_n"))


def percentiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float] = PERCENTILES,
    *,
    by: Sequence[str] = (),
    method: str = "truncated",
    stats: DataFrame | None = None,
    small: int = SMALL,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``by..., prob, value`` for every group and probability.

    ``stats`` are the ``group_statistics`` of the same rows and probabilities, if they are known already. The counts of
    values inside brackets are range partitioned by group and value; sums per block tell which
    block holds a wanted place, and only those are ordered. How many blocks there are follows from the counts.
    """
    by, probs = list(by), list(probs)
    if not probs:
        raise ValueError("no probabilities are wanted")
    stats = group_statistics(df, value, probs, by) if stats is None else stats
    counts = durable(_counted(df, value, stats, by, len(probs), small))
    blocks = max(1, -(-counts.count() // block_values))
    order = [*by, "_v", "_gap"]
    if blocks == 1:
        ordered = counts.withColumn("_block", F.lit(0))
    else:
        ordered = durable(counts.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))

    over = W.partitionBy(*by).orderBy("_block")
    block = ordered.groupBy(*by, "_block").agg(F.sum("_n").alias("_block_n"))
    block = block.withColumns({
        "_start": F.coalesce(F.sum("_block_n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_block_n").over(W.partitionBy(*by)),
    })
    names = [f"_g{k}" for k in range(len(by))]
    wanted = block.select(*[F.col(b).alias(g) for b, g in zip(by, names)], F.col("_block").alias("_b"), "_start", "_block_n", F.explode(_places(F.col("_total"), probs, method)).alias("_p"))
    ends = F.array(F.struct(F.lit("at").alias("end"), F.col("_p.at").alias("place")), F.struct(F.lit("next").alias("end"), F.col("_p.next").alias("place")))
    wanted = (
        wanted.withColumn("_e", F.explode(ends))
        .where((F.col("_e.place") >= F.col("_start")) & (F.col("_e.place") < F.col("_start") + F.col("_block_n")))
        .select(*names, "_b", "_p.prob", "_p.part", "_e.end", (F.col("_e.place") - F.col("_start")).alias("_place"))
    )

    own = same([F.col(b) for b in by], [F.col(g) for g in names]) & (F.col("_block") == F.col("_b"))
    upto = F.sum("_n").over(W.partitionBy(*by, "_block").orderBy("_v", "_gap").rowsBetween(W.unboundedPreceding, 0))
    ranked = ordered.join(wanted.select(*names, "_b").distinct(), own, "left_semi").withColumn("_upto", upto)
    found = durable(ranked.join(wanted, own & (F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_n"))))
    if found.where("_gap").limit(1).count():
        # a sketch was worse than it promises: order everything
        return percentiles(df, value, probs, by=by, method=method, stats=stats, small=1 << 62, block_values=block_values)
    at = F.max(F.when(F.col("end") == "at", F.col("_v")))
    nxt = F.max(F.when(F.col("end") == "next", F.col("_v")))
    return found.groupBy(*by, "prob").agg((at + F.max("part") * (nxt - at)).alias("value"))
