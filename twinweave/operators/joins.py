"""Keyed event-time joins of two inputs: interval (band) and window joins.

Times are whole numbers in any one unit. A plain join on the key compares all rows of
a key with each other, which is quadratic on few or hot keys. The joins here add a
time bucket to the equi-join columns, so a row meets only rows from about its own
time, and split the (key, bucket) cells that still hold too many pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twinweave.functions.integers import as_long, floor_div
from twinweave.model import BALANCE_LIMIT
from twinweave.operators import heavy, skew
from twinweave.session import task_slots

STRATEGIES = ("auto", "key", "bucket", "data", "hybrid")


@dataclass(frozen=True)
class Side:
    """Columns of one join input: ``side.value`` or ``side["value"]``."""

    prefix: str
    names: tuple[str, ...]

    def __getitem__(self, name: str) -> Column:
        if name not in self.names:
            raise KeyError(f"no column {name!r}; there are {', '.join(self.names)}")
        return F.col(f"`{self.prefix}{name}`")

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as error:
            raise AttributeError(str(error)) from None


PairColumns = Callable[[Side, Side], Sequence[Column]]
PairCondition = Callable[[Side, Side], Column]


def numeric_pair(key: str = "key", value: str = "value", ts: str = "ts") -> PairColumns:
    """Key, sum of values, later of both times."""
    return lambda a, b: [
        a[key].alias(key),
        (a[value] + b[value]).alias(value),
        F.greatest(a[ts], b[ts]).alias(ts),
    ]


def text_pair(key: str = "key", value: str = "value", ts: str = "ts") -> PairColumns:
    """Key, values written one after the other, later of both times."""
    return lambda a, b: [
        a[key].alias(key),
        F.concat(a[value], b[value]).alias(value),
        F.greatest(a[ts], b[ts]).alias(ts),
    ]


@dataclass(frozen=True)
class SumBelow:
    """A pair condition of which the joins know that a row without a small enough partner can be left out before it is shuffled."""

    limit: int
    value: str = "value"

    def __call__(self, a: Side, b: Side) -> Column:
        return (a[self.value] + b[self.value]) < F.lit(self.limit)

    def narrowed(self, left: DataFrame, right: DataFrame, a: Side, b: Side) -> tuple[DataFrame, DataFrame]:
        """Both inputs without the rows that exceed the limit even with the least value of the other input: two aggregates over one column, no shuffle of rows."""
        def wide(c: Column) -> Column:
            return c.cast("decimal(20,0)") if whole else c  # sums of two longs do not overflow

        whole = all(dict(df.dtypes)[f"{s.prefix}{self.value}"] in ("tinyint", "smallint", "int", "bigint") for df, s in ((left, a), (right, b)))
        x, y = a[self.value], b[self.value]
        least_x, least_y = left.agg(F.min(x)).scalar(), right.agg(F.min(y)).scalar()
        return left.where(wide(x) + wide(least_y) < F.lit(self.limit)), right.where(wide(y) + wide(least_x) < F.lit(self.limit))


def sum_below(limit: int, value: str = "value") -> PairCondition:
    """Keep a pair only if its values add up to less than ``limit``."""
    return SumBelow(limit, value)


def tag(df: DataFrame, prefix: str) -> tuple[DataFrame, Side]:
    """``df`` with prefixed columns, so that both inputs may come from one table."""
    return df.select([F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns]), Side(prefix, tuple(df.columns))


def pair_columns(a: Side, b: Side, select: PairColumns | None) -> list[Column]:
    if select is not None:
        return list(select(a, b))
    return [a[c].alias(f"a_{c}") for c in a.names] + [b[c].alias(f"b_{c}") for c in b.names]


def interval_join(
    a: DataFrame,
    b: DataFrame,
    on: str | Sequence[str],
    a_time: str,
    b_time: str,
    lower: int,
    upper: int,
    *,
    select: PairColumns | None = None,
    where: PairCondition | None = None,
    strategy: str = "auto",
    split_by: str = "cell",
    bucket_width: int | None = None,
    workers: int | None = None,
    threshold: float = BALANCE_LIMIT,
    max_split: int | None = None,
    row_id: str | None = None,
    a_row_id: str | None = None,
) -> DataFrame:
    """Pairs with equal ``on`` and ``a_time + lower <= b_time <= a_time + upper``, both ends included.

    ``strategy`` only decides where rows go, never which pairs come out:

    * ``key``: all rows of a key in one task, the fewest copies; for many small keys.
    * ``bucket``: a cell of key and time bucket in one task; cheapest where no cell is hot.
    * ``data``: every cell spread over ``max_split`` tasks (default: all workers).
    * ``hybrid``: cells with a large share of all rows spread over more tasks.
    * ``auto``: cells with a large share of all candidate pairs spread over more tasks.

    ``hybrid`` and ``auto`` sketch the cells of both inputs in one job of their own first. With
    ``split_by="key"`` they look for hot keys instead and split every cell of a hot key.
    Both inputs are divided by a grid of salts in proportion to their rows in the cell.
    ``row_id`` names a column of ``b`` that tells its rows apart, ``a_row_id`` one of ``a``. Without it the
    salt of a row comes from its whole content, and exact copies of one row stay together.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if split_by not in ("cell", "key"):
        raise ValueError("split_by must be cell or key")
    if a.isStreaming or b.isStreaming:
        raise ValueError("these are streams: use stream_interval_join")
    if bucket_width is not None and bucket_width < 1:
        raise ValueError("bucket_width must be positive")
    left, a_side = tag(a, "a__")
    right, b_side = tag(b, "b__")
    if isinstance(where, SumBelow):
        left, right = where.narrowed(left, right, a_side, b_side)
    at, bt = a_side[a_time], b_side[b_time]
    within = (bt >= at + as_long(lower)) & (bt <= at + as_long(upper))
    if where is not None:
        within = within & where(a_side, b_side)
    if lower > upper:
        within = F.lit(False)
    width = max(1, upper - lower) if bucket_width is None else bucket_width
    joined = _meet(
        left, right, a_side, b_side, keys, within,
        spans=None if strategy == "key" or lower > upper else (
            floor_div(at + as_long(lower), width), floor_div(at + as_long(upper), width), floor_div(bt, width)),
        strategy=strategy, split_by=split_by, workers=workers, threshold=threshold, max_split=max_split, row_id=row_id, a_row_id=a_row_id,
        copied=max(0, upper - lower) // width + 2,
    )
    return joined.select(*pair_columns(a_side, b_side, select))


def window_join(
    a: DataFrame,
    b: DataFrame,
    on: str | Sequence[str],
    a_time: str,
    b_time: str,
    size: int,
    slide: int | None = None,
    *,
    select: PairColumns | None = None,
    where: PairCondition | None = None,
    strategy: str = "auto",
    workers: int | None = None,
    threshold: float = BALANCE_LIMIT,
    max_split: int | None = None,
    row_id: str | None = None,
    a_row_id: str | None = None,
) -> DataFrame:
    """Pairs with equal ``on`` in the same window; once for every window they share.

    Windows start at all multiples of ``slide`` (default ``size``: tumbling) and hold times
    ``w_start <= t < w_start + size``; ``w_start`` is added to the output. With
    ``slide > size`` there are gaps, and rows in a gap join nothing.

    Overlapping windows are not written out per row. Two rows share a window only if
    they are less than ``size`` apart, and how many they share follows from their
    times, so this is a band join whose result rows are repeated afterwards: a row is
    shuffled at most twice, not ``size / slide`` times.
    """
    slide = size if slide is None else slide
    if size < 1 or slide < 1:
        raise ValueError("size and slide must be positive")
    if a.isStreaming or b.isStreaming:
        raise ValueError("these are streams: use stream_window_join")
    keys = [on] if isinstance(on, str) else list(on)
    left, a_side = tag(a, "a__")
    right, b_side = tag(b, "b__")
    if isinstance(where, SumBelow):
        left, right = where.narrowed(left, right, a_side, b_side)
    at, bt = a_side[a_time], b_side[b_time]
    condition = where(a_side, b_side) if where is not None else F.lit(True)
    options = dict(strategy=strategy, workers=workers, threshold=threshold, max_split=max_split, row_id=row_id, a_row_id=a_row_id)

    if slide >= size:
        if slide > size:
            left = left.where(F.pmod(at, as_long(slide)) < as_long(size))
            right = right.where(F.pmod(bt, as_long(slide)) < as_long(size))
        window = floor_div(at, slide)
        joined = _meet(left, right, a_side, b_side, keys, condition, spans=(window, window, floor_div(bt, slide)), always_bucket=True, **options)
        return joined.select(*pair_columns(a_side, b_side, select), (window * as_long(slide)).alias("w_start"))

    earlier, later = F.least(at, bt), F.greatest(at, bt)
    first = floor_div(later - as_long(size), slide) + 1
    last = floor_div(earlier, slide)
    reach = size - 1
    width = max(1, 2 * reach)
    joined = _meet(
        left, right, a_side, b_side, keys, condition & (first <= last),
        spans=None if strategy == "key" else (
            floor_div(at - as_long(reach), width), floor_div(at + as_long(reach), width), floor_div(bt, width)),
        **options,
    )
    starts = F.explode(F.sequence(first * as_long(slide), last * as_long(slide), as_long(slide)))
    return joined.select(*pair_columns(a_side, b_side, select), starts.alias("w_start"))


def _meet(
    left: DataFrame,
    right: DataFrame,
    a: Side,
    b: Side,
    keys: list[str],
    condition: Column,
    *,
    spans: tuple[Column, Column, Column] | None,
    strategy: str,
    workers: int | None,
    threshold: float,
    max_split: int | None,
    row_id: str | None,
    a_row_id: str | None,
    split_by: str = "cell",
    always_bucket: bool = False,
    copied: int = 2,
) -> DataFrame:
    """The equi-join behind both joins.

    ``spans`` gives first and last bucket of an ``a`` row and the one bucket of a ``b``
    row. An ``a`` row is copied to every bucket of its span (at most ``copied``) and a ``b`` row goes to one,
    so no pair can meet twice.
    """
    many = spans is not None and copied > 2
    equal = [(f"a__{k}", f"b__{k}") for k in keys]
    from_a = [a[a_row_id]] if a_row_id else [a[c] for c in a.names]
    from_b = [b[row_id]] if row_id else [b[c] for c in b.names]
    if spans is not None:
        first, last, own = spans
        if not always_bucket:
            left = left.withColumn("_a_bucket", F.explode(F.sequence(first, last)))
        else:
            left = left.withColumn("_a_bucket", first)
        right = right.withColumn("_b_bucket", own)
        equal.append(("_a_bucket", "_b_bucket"))

    if max_split is not None and max_split < 1:
        raise ValueError("max_split must be at least 1")
    if workers is not None and workers < 1:
        raise ValueError("workers must be at least 1")
    if strategy in ("data", "hybrid", "auto") and spans is not None:
        workers = workers or task_slots(left.sparkSession)
        if strategy == "data":
            salted = skew.spread_grid(left, right, [], from_a, from_b, splits=workers if max_split is None else max_split)
        else:
            cells = equal if split_by == "cell" else equal[: len(keys)]
            salted = _split_hot(left, right, cells, from_a, from_b, strategy, workers, threshold, max_split)
        if salted:
            left, right = (side.withColumnsRenamed({"_salt_a": f"_{n}_salt_a", "_salt_b": f"_{n}_salt_b"}) for side, n in zip(salted, "ab"))
            equal += [("_a_salt_a", "_b_salt_a"), ("_a_salt_b", "_b_salt_b")]
            many = True

    if many:
        # Spark's estimate of an input knows nothing of its copies: taken for small, all of them would be broadcast through the driver
        left, right = left.hint("merge"), right.hint("merge")
    on = condition
    for l, r in reversed(equal):
        on = (F.col(f"`{l}`") == F.col(f"`{r}`")) & on
    return left.join(right, on, "inner")


def _split_hot(left, right, cells, from_a, from_b, strategy, workers, threshold, max_split):
    """Both inputs with salts for their hot cells, or None if no cell is hot. One job sketches both inputs where they lie."""
    numbers = heavy.paired_cells(left, right, cells)
    if numbers is None:
        return None
    left, right = left.withColumn("_cell", numbers[0]), right.withColumn("_cell", numbers[1])
    named = [side.select(F.col("_cell").alias("cell")) for side in (left, right)]
    hot = heavy.hot_grid(*named, workers, threshold, max_split, pairs=strategy == "auto")
    if hot is None:
        return None
    left, right = skew.spread_grid(left, right, ["_cell"], from_a, from_b, hot=hot.withColumnRenamed("cell", "_cell"))
    return left.drop("_cell"), right.drop("_cell")
