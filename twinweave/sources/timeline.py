"""Event time of file-driven streams: running sums of gaps, replay, source copies, pace and run length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinweave.functions.integers import as_long, floor_div
from twinweave.model import EVENT_TIME_BASE_MS, RUN_SECONDS, STRING_STREAM_SHIFT_MS, ZERO_OFFSET_MS
from twinweave.operators.scan import running_total


def gap_ms(offset: str | Column = "ts_off", zero_offset: int = ZERO_OFFSET_MS) -> Column:
    """Milliseconds a row adds to the clock; an offset of 0 stands for ``zero_offset``."""
    offset = F.col(offset) if isinstance(offset, str) else offset
    return F.when(offset == 0, as_long(zero_offset)).otherwise(offset)


def with_event_time(
    df: DataFrame, *, row_id: str = "row_id", offset: str = "ts_off", base_ms: int = EVENT_TIME_BASE_MS, out: str = "event_us"
) -> DataFrame:
    """``df`` plus its event time in us: ``base_ms`` plus all gaps up to and including the row's own.

    Streams of window joins start at ``base_ms=0``.
    """
    timed = running_total(df, gap_ms(offset), row_id, "_elapsed_ms")
    return timed.withColumn(out, (as_long(base_ms) + F.col("_elapsed_ms")) * as_long(1000)).drop("_elapsed_ms")


def replay(
    df: DataFrame,
    passes: int,
    *,
    row_id: str = "row_id",
    offset: str = "ts_off",
    base_ms: int = EVENT_TIME_BASE_MS,
    out: str = "event_us",
) -> DataFrame:
    """The dataset ``passes`` times in a row, as ``pass`` 0, 1, ...; event time goes on growing.

    One pass lasts as long as all its gaps, so later passes are the first one moved:
    the running sum is computed once, whatever the number of passes.
    """
    total = df.agg(F.coalesce(F.sum(gap_ms(offset)), F.lit(0))).scalar()
    once = with_event_time(df, row_id=row_id, offset=offset, base_ms=base_ms, out=out)
    return repeat(once, passes, total * as_long(1000), out=out)


def repeat(timed: DataFrame, passes: int, span_us: Column, *, out: str = "event_us") -> DataFrame:
    """A stream that already has its event time ``passes`` times in a row, each ``span_us`` after the one before."""
    turns = timed.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), as_long(passes - 1))))
    return turns.withColumn(out, F.col(out) + F.col("pass") * span_us)


def replicate(df: DataFrame, parallelism: int) -> DataFrame:
    """Every row once per source copy, as ``replica`` 0..parallelism-1: each copy plays the whole dataset."""
    return df.withColumn("replica", F.explode(F.sequence(F.lit(0).cast("long"), as_long(parallelism - 1))))


def paced(df: DataFrame, rate: float, *, position: str = "row_id", out: str = "emit_us") -> DataFrame:
    """When each row leaves a source limited to ``rate`` rows per second, in us after its start (0: no limit)."""
    at = as_long(0) if rate == 0 else F.floor(F.col(position) * F.lit(1e6 / rate))
    return df.withColumn(out, at)


def bounded_run(df: DataFrame, seconds: float = RUN_SECONDS, *, emitted: str = "emit_us") -> DataFrame:
    """The rows that leave the source before the run is over."""
    return df.where(F.col(emitted) <= as_long(int(seconds * 1_000_000)))


def passes_in_run(rows: int, rate: float, seconds: float = RUN_SECONDS) -> int:
    """How many passes over a dataset a rate-limited run of this length begins."""
    return int(rate * seconds) // rows + 1


def shifted(df: DataFrame, *, ts_ms: str = "ts", shift_ms: int = STRING_STREAM_SHIFT_MS, out: str = "event_us") -> DataFrame:
    """Event time in us of a record time in ms, moved by a constant."""
    return df.withColumn(out, (F.col(ts_ms) + as_long(shift_ms)) * as_long(1000))


def position_in_pass(df: DataFrame, rows: Column, *, position: str = "value") -> DataFrame:
    """``pass`` and ``row_id`` of an endless counter over a dataset of ``rows`` rows."""
    return df.withColumns({"pass": floor_div(F.col(position), rows), "row_id": F.pmod(F.col(position), rows)})
