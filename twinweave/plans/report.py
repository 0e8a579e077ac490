"""Roll-ups of stored results: what the charts of an experiment are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from twinweave.functions.clock import us_to_ms
from twinweave.model import PERCENTILE_NAMES


def run_average(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over runs of each percentile and of the mean latency, in ms: ``p0 .. p100, mean_ms``."""
    return metrics.groupBy(*by).agg(
        *[F.avg(us_to_ms(F.col(f"`{n}`"))).alias(f"p{n}") for n in PERCENTILE_NAMES],
        F.avg(us_to_ms(F.col("mean"))).alias("mean_ms"),
    )


def throughput_spread(throughput: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over runs."""
    return throughput.groupBy(*by).agg(F.avg("throughput").alias("mean_throughput"), F.stddev_pop("throughput").alias("std_throughput"))


def config_averages(metrics: DataFrame, throughput: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean latency in ms and mean throughput of each configuration that has both."""
    latency = metrics.groupBy(*by).agg(F.avg(us_to_ms(F.col("mean"))).alias("mean_ms"))
    rate = throughput.groupBy(*by).agg(F.avg("throughput").alias("mean_throughput"))
    return latency.join(rate, list(by))


def comparison(df: DataFrame, by: str, variant: str, variants: Sequence[str], value: Column | str) -> DataFrame:
    """One row per ``by`` and one column of means per variant, where every variant has results."""
    value = F.col(value) if isinstance(value, str) else value
    wide = df.groupBy(by).pivot(variant, list(variants)).agg(F.avg(value))
    return wide.dropna("any", subset=list(variants))


def in_label_order(df: DataFrame, label: str) -> DataFrame:
    """Sorted by the number a text label stands for, so that 16 comes after 8."""
    return df.orderBy(F.col(label).cast("int"))
