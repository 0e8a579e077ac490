"""Integer arithmetic that stays exact for 64-bit times (no detour over doubles)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_long(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("long")


def floor_div(x: Column, width: int | Column) -> Column:
    """Largest whole q with ``q * width <= x``; rounds down for negative x as well."""
    width = as_long(width)
    return F.call_function("div", x - F.pmod(x, width), width)


def trunc_div(x: Column, width: int | Column) -> Column:
    """Integer quotient rounded towards zero."""
    return F.call_function("div", x, as_long(width))
