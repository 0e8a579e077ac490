"""Pseudo-random columns that depend on the row id alone.

``rand()`` depends on how rows fall into partitions, so a task that is run again
after an executor was lost may draw other numbers. Hashing the row id gives the
same draw wherever and however often the row is computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession, functions as F

from twinweave import model
from twinweave.functions.integers import as_long

_STEPS = 1 << 53


def unit_draw(row_id: Column, seed: int, stream: int = 0) -> Column:
    """Uniform double in [0, 1)."""
    bits = F.pmod(F.xxhash64(row_id.cast("long"), as_long(seed), as_long(stream)), as_long(_STEPS))
    return bits.cast("double") / F.lit(float(_STEPS))


def uniform_int(u: Column, low: int, high: int) -> Column:
    """Whole number in low..high, both ends included."""
    return F.lit(low).cast("long") + F.floor(u * F.lit(float(high - low + 1)))


def offset_ms(u: Column) -> Column:
    return uniform_int(u, 0, model.MAX_OFFSET_MS)


def zeta(spark: SparkSession, n: int, theta: float) -> float:
    """Sum of i^-theta for i in 1..n."""
    i = F.col("id").cast("double")
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.lit(1.0) / i, F.lit(theta)))).first()[0]


def zipf_int(u: Column, low: int, high: int, theta: float, zeta_n: float) -> Column:
    """Zipf-distributed key in low..high for 0 < theta < 1, by the closed-form inverse of
    Gray et al., "Quickly generating billion-record synthetic databases" (SIGMOD 1994)."""
    if not 0.0 < theta < 1.0:
        raise ValueError("theta must lie between 0 and 1")
    if low > high:
        raise ValueError("empty key range")
    n = high - low + 1
    second = 0.5 ** theta
    zeta_2 = 1.0 + second
    scaled = u * F.lit(zeta_n)
    first_key, second_key = F.lit(low).cast("long"), F.lit(low + 1).cast("long")
    if n <= 2:
        # eta is undefined here, and two keys are covered by the first two branches
        return F.when(scaled < 1.0, first_key).otherwise(F.lit(high).cast("long"))
    eta = (1.0 - (2.0 / n) ** (1.0 - theta)) / (1.0 - zeta_2 / zeta_n)
    tail = F.pow(F.lit(eta) * u - F.lit(eta) + F.lit(1.0), F.lit(1.0 / (1.0 - theta)))
    return (
        F.when(scaled < 1.0, first_key)
        .when(scaled < zeta_2, second_key)
        .otherwise(first_key + (F.lit(float(n)) * tail).cast("long"))
    )


def self_similar_int(u: Column, low: int, high: int, skew: float) -> Column:
    """Key in low..high of which the first ``skew`` share of keys gets ``1 - skew`` of the rows."""
    if not 0.0 < skew < 1.0:
        raise ValueError("skew must lie between 0 and 1")
    if low > high:
        raise ValueError("empty key range")
    power = F.lit(math.log(skew) / math.log(1.0 - skew))
    return F.lit(low).cast("long") + (F.lit(float(high - low + 1)) * F.pow(u, power)).cast("long")
