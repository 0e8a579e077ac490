"""Conversions between timestamps and integer times, and between time units."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from twinweave.functions.integers import trunc_div


def ntz_micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone is.

    ``timestampdiff`` and ``unix_micros`` go through the session time zone, where the hour
    skipped in spring does not exist; a difference of two zone-less timestamps does not.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = (ts - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("long")


def ns_to_us(ns: Column) -> Column:
    """Exact microseconds as a double."""
    return ns / F.lit(1e3)


def ns_to_whole_us(ns: Column) -> Column:
    """Microseconds cut to an integer, the way latencies of integer type are stored."""
    return trunc_div(ns, 1000)


def us_to_ms(us: Column) -> Column:
    return us / F.lit(1000.0)


def ms_to_us(ms: Column) -> Column:
    return ms * F.lit(1000).cast("long")
