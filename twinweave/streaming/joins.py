"""Stream-stream joins with state bounded by watermarks.

Event time is a TIMESTAMP column, one per input. Both joins keep only the rows that can
still find a partner; Spark drops the state once the watermarks of both inputs have passed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from twinweave.functions.integers import as_long, floor_div
from twinweave.operators.joins import PairColumns, PairCondition, Side, pair_columns, tag
from twinweave.operators import heavy
from twinweave.operators.skew import split_degree
from twinweave.streaming.splits import SplitLog

def split_table(freq: DataFrame, key: str, workers: int, share_a: float = 0.5) -> DataFrame:
    """``key, splits_a, splits_b`` of the keys that hold more than their part of a stream, from probabilities known
    before the run (``key, prob``); ``share_a`` is the first stream's share of all rows."""
    if not 0 < share_a < 1:
        raise ValueError("share_a must lie between 0 and 1")
    splits = split_degree(F.col("prob"), workers)
    ideal = F.sqrt(splits * F.lit(share_a / (1 - share_a)))
    split_a = F.greatest(F.lit(1), F.least(splits, F.round(ideal))).cast("long")
    return freq.where(splits > 1).select(key, split_a.alias("splits_a"), F.ceil(splits / split_a).cast("long").alias("splits_b"))


def _salted(left: DataFrame, right: DataFrame, a: Side, b: Side, keys: list[str], splits: SplitLog | None, salts: int, a_row_id: str | None, row_id: str | None,
            starts: tuple[Column, Column] | None):
    """Both streams with a grid of salts, and the pairs of columns to join on. ``starts`` is when the cell of a row begins, which decides the epoch of its grid."""
    if splits is None and salts <= 1:
        return left, right, []
    if splits is not None:
        cells = heavy.paired_cells(left, right, [(f"a__{k}", f"b__{k}") for k in keys])
        if cells is None:
            raise ValueError("the key columns of both streams must have one type")
        if not splits.epochs():
            raise ValueError("the split log has no first epoch")
        left, right = (splits.grid(side, cell, start, "_n_") for side, cell, start in zip((left, right), cells, starts or (None, None)))
        n_a, n_b = F.col("_n_a"), F.col("_n_b")
    else:
        n_a, n_b = as_long(1), as_long(salts)
    own_a = [a[a_row_id]] if a_row_id else [a[c] for c in a.names]
    own_b = [b[row_id]] if row_id else [b[c] for c in b.names]
    zero = as_long(0)
    left = left.withColumn("_a_salt_a", F.pmod(F.xxhash64(*own_a), n_a)).withColumn("_a_salt_b", F.explode(F.sequence(zero, n_b - 1))).drop("_n_a", "_n_b")
    right = right.withColumn("_b_salt_b", F.pmod(F.xxhash64(*own_b), n_b)).withColumn("_b_salt_a", F.explode(F.sequence(zero, n_a - 1))).drop("_n_a", "_n_b")
    return left, right, [(F.col("_a_salt_a"), F.col("_b_salt_a")), (F.col("_a_salt_b"), F.col("_b_salt_b"))]


def stream_interval_join(
    a: DataFrame,
    b: DataFrame,
    on: str | Sequence[str],
    a_time: str,
    b_time: str,
    lower_us: int,
    upper_us: int,
    *,
    delay: str = "0 seconds",
    select: PairColumns | None = None,
    where: PairCondition | None = None,
    bucketed: bool = True,
    salts: int = 1,
    splits: SplitLog | None = None,
    row_id: str | None = None,
    a_row_id: str | None = None,
) -> DataFrame:
    """Pairs with equal ``on`` and ``a_time + lower_us <= b_time <= a_time + upper_us``.

    The state of a key is a list that every arriving row of the other input is checked
    against. With ``bucketed`` it is split by time, so few keys do not mean long lists.
    ``salts`` spreads each list of ``b`` over that many tasks; ``splits`` gives each hot key a grid of its own instead, in proportion to the rows of both streams.
    The grids are stored with the query and may change from a time on: see ``twinweave.streaming.splits``.
    """
    keys = [on] if isinstance(on, str) else list(on)
    left, a_side = tag(a, "a__")
    right, b_side = tag(b, "b__")
    left = left.withWatermark(f"a__{a_time}", delay)
    right = right.withWatermark(f"b__{b_time}", delay)
    at, bt = a_side[a_time], b_side[b_time]
    condition = (bt >= at + F.lit(timedelta(microseconds=lower_us))) & (bt <= at + F.lit(timedelta(microseconds=upper_us)))
    if lower_us > upper_us:
        condition = condition & F.lit(False)
    if where is not None:
        condition = condition & where(a_side, b_side)
    equal = [(a_side[k], b_side[k]) for k in keys]
    starts = None
    if bucketed and lower_us <= upper_us:
        width = max(1, upper_us - lower_us)
        first = floor_div(F.unix_micros(at) + as_long(lower_us), width)
        last = floor_div(F.unix_micros(at) + as_long(upper_us), width)
        left = left.withColumn("_a_bucket", F.explode(F.sequence(first, last)))
        right = right.withColumn("_b_bucket", floor_div(F.unix_micros(bt), width))
        equal.append((F.col("_a_bucket"), F.col("_b_bucket")))
        starts = F.col("_a_bucket") * as_long(width), F.col("_b_bucket") * as_long(width)
    left, right, grid = _salted(left, right, a_side, b_side, keys, splits, salts, a_row_id, row_id, starts)
    equal += grid
    for l, r in reversed(equal):
        condition = (l == r) & condition
    return left.join(right, condition, "inner").select(*pair_columns(a_side, b_side, select))


def stream_window_join(
    a: DataFrame,
    b: DataFrame,
    on: str | Sequence[str],
    a_time: str,
    b_time: str,
    size_us: int,
    slide_us: int | None = None,
    *,
    delay: str = "0 seconds",
    select: PairColumns | None = None,
    where: PairCondition | None = None,
    splits: SplitLog | None = None,
    row_id: str | None = None,
    a_row_id: str | None = None,
) -> DataFrame:
    """Pairs with equal ``on`` in the same window, once per shared window; ``w_start`` in us is added.

    ``splits`` gives hot keys a grid of tasks, as in ``stream_interval_join``.

    Overlapping windows (``slide_us < size_us``) are a band join whose pairs are repeated: a row is in state twice at
    most, not ``size / slide`` times. ``F.window`` has no windows with gaps. For ``slide_us > size_us`` the rows in gaps are
    filtered out, which makes them tumbling windows of length ``slide_us``.
    """
    slide_us = size_us if slide_us is None else slide_us
    if size_us < 1 or slide_us < 1:
        raise ValueError("size and slide must be positive")
    if slide_us < size_us:
        def windows(x: Side, y: Side) -> tuple[Column, Column]:
            """First and last of the windows that two rows share."""
            x_us, y_us = F.unix_micros(x[a_time]), F.unix_micros(y[b_time])
            return floor_div(F.greatest(x_us, y_us) - as_long(size_us), slide_us) + 1, floor_div(F.least(x_us, y_us), slide_us)

        def shared(x: Side, y: Side) -> Column:
            first, last = windows(x, y)
            return (first <= last) if where is None else (first <= last) & where(x, y)

        def repeated(x: Side, y: Side) -> list[Column]:
            first, last = (n * as_long(slide_us) for n in windows(x, y))
            return [*pair_columns(x, y, select), F.explode(F.sequence(first, last, as_long(slide_us))).alias("w_start")]

        return stream_interval_join(a, b, on, a_time, b_time, 1 - size_us, size_us - 1, delay=delay, select=repeated, where=shared,
                                    splits=splits, row_id=row_id, a_row_id=a_row_id)
    keys = [on] if isinstance(on, str) else list(on)
    left, a_side = tag(a, "a__")
    right, b_side = tag(b, "b__")
    left = left.withWatermark(f"a__{a_time}", delay)
    right = right.withWatermark(f"b__{b_time}", delay)
    at, bt = a_side[a_time], b_side[b_time]
    length = size_us
    if slide_us > size_us:
        left = left.where(F.pmod(F.unix_micros(at), as_long(slide_us)) < as_long(size_us))
        right = right.where(F.pmod(F.unix_micros(bt), as_long(slide_us)) < as_long(size_us))
        length = slide_us
    window = [f"{length} microseconds", f"{slide_us} microseconds"]
    # A stream may have one event-time column: the window. The time itself goes on as an ordinary timestamp.
    left = left.withColumn("_a_window", F.window(at, *window)).withColumn(f"a__{a_time}", F.timestamp_micros(F.unix_micros(at)))
    right = right.withColumn("_b_window", F.window(bt, *window)).withColumn(f"b__{b_time}", F.timestamp_micros(F.unix_micros(bt)))
    condition = F.col("_a_window") == F.col("_b_window")
    starts = F.unix_micros(F.col("_a_window.start")), F.unix_micros(F.col("_b_window.start"))
    left, right, grid = _salted(left, right, a_side, b_side, keys, splits, 1, a_row_id, row_id, starts)
    for l, r in reversed(grid):
        condition = (l == r) & condition
    for k in reversed(keys):
        condition = (a_side[k] == b_side[k]) & condition
    if where is not None:
        condition = condition & where(a_side, b_side)
    start = F.unix_micros(F.col("_a_window.start")).alias("w_start")
    return left.join(right, condition, "inner").select(*pair_columns(a_side, b_side, select), start)
