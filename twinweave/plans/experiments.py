"""The experiments of the benchmark as Spark jobs: from dataset to joined rows to result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinweave import model
from twinweave.functions.integers import as_long, trunc_div
from twinweave.operators import accounting
from twinweave.operators.joins import interval_join, numeric_pair, sum_below, text_pair, window_join
from twinweave.operators.sampling import rate_sample
from twinweave.session import durable
from twinweave.sources.files import read_pair, read_synthetic
from twinweave.sources.generated import round_robin
from twinweave.sources.timeline import repeat, replicate, shifted, with_event_time


def load_streams(
    spark: SparkSession, path: str, *, passes: int = 1, copies: tuple[int, int] = (1, 1), base_ms: int = model.EVENT_TIME_BASE_MS
) -> tuple[DataFrame, DataFrame]:
    """Both inputs of a synthetic dataset with event time in us, played ``passes`` times by each source copy.

    A join reads its inputs more than once, so they are written once with their times
    (each pass and copy is made on reading).
    """
    def stream(df: DataFrame, n: int) -> DataFrame:
        timed = durable(with_event_time(df, base_ms=base_ms, out="ts"))
        span = timed.agg(F.coalesce(F.max("ts"), as_long(0)) - as_long(base_ms * 1000)).scalar()
        played = repeat(timed, passes, span, out="ts")
        return replicate(played, n).select("row_id", "pass", "replica", "key", "value", "ts")

    a, b = read_pair(read_synthetic, spark, path)
    return stream(a, copies[0]), stream(b, copies[1])


def interval_experiment(a: DataFrame, b: DataFrame, lower_ms: int = -500, upper_ms: int = 500, *, strategy: str = "auto", filtered: bool = True) -> DataFrame:
    """Interval join of two numeric streams (``key, value, ts``); ``filtered`` keeps small sums only."""
    return interval_join(
        a, b, "key", "ts", "ts", lower_ms * 1000, upper_ms * 1000, strategy=strategy, select=numeric_pair(),
        where=sum_below(model.PAIR_SUM_LIMIT) if filtered else None,
    )


def window_experiment(a: DataFrame, b: DataFrame, size_ms: int, slide_ms: int | None = None, *, strategy: str = "auto", filtered: bool = True) -> DataFrame:
    """Window join of two numeric streams (``key, value, ts``)."""
    return window_join(
        a, b, "key", "ts", "ts", size_ms * 1000, None if slide_ms is None else slide_ms * 1000, strategy=strategy,
        select=numeric_pair(), where=sum_below(model.PAIR_SUM_LIMIT) if filtered else None,
    )


def comparison_streams(positions: DataFrame, num_keys: int) -> tuple[DataFrame, DataFrame]:
    """Round-robin string streams: one of as many rows as ``positions`` (``row_id`` 0..n-1), one of twice as many."""
    n = positions.agg(F.count("*")).scalar()
    passes = positions.withColumn("_pass", F.explode(F.sequence(as_long(0), as_long(1))))
    twice = passes.select((F.col("row_id") + F.col("_pass") * n).alias("row_id"))
    longest = n * 2
    base = round_robin(positions, num_keys, count=n, max_ts=longest)
    probe = round_robin(twice, num_keys, count=n * 2, max_ts=longest)
    return shifted(base), shifted(probe)


def comparison_join(base: DataFrame, probe: DataFrame, window_us: int = 5000, slide_us: int = 100_000) -> DataFrame:
    """``key, value, event_ms, w_start``: sliding-window join with values written one after the other."""
    joined = window_join(base, probe, "key", "event_us", "event_us", window_us, slide_us, select=text_pair(ts="event_us"))
    return joined.select("key", "value", trunc_div(F.col("event_us"), 1000).alias("event_ms"), "w_start")


def result_record(
    latencies: DataFrame, *, rate: float = model.SAMPLES_PER_SECOND, epoch: int | Column | None = None, method: str = "truncated", run_id: str = "run"
) -> DataFrame:
    """The stored record of a run from ``sink_id, at_ns, latency_us``: each sink samples on its own, then all samples count as one.

    ``epoch`` is when the samplers were made, in the unit of ``at_ns``; by default each sink's first time.
    """
    named = latencies.withColumn("run_id", F.lit(run_id))
    if epoch is None:
        # a row per sink; times are counted from there
        begun = named.groupBy(F.col("sink_id").alias("_sink")).agg(F.min("at_ns").alias("_begun"))
        named = named.join(begun, F.col("sink_id").eqNullSafe(F.col("_sink"))).withColumn("at_ns", F.col("at_ns") - F.col("_begun")).drop("_sink", "_begun")
        epoch = 0
    totals = named.groupBy("run_id").agg(F.count("*").alias("total"))
    kept = rate_sample(named, sink="sink_id", at="at_ns", rate=rate, epoch=epoch, order=["latency_us"])
    return accounting.latency_summary(kept, "latency_us", ["run_id"], totals=totals, method=method)

