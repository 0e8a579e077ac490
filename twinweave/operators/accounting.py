"""Counting what ran: rows, bytes, rates, throughput, and the latency summary of a run."""

from __future__ import annotations

from collections.abc import Sequence
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from twinweave.functions.integers import as_long
from twinweave.model import PERCENTILE_NAMES, PERCENTILES
from twinweave.operators.quantiles import group_statistics, percentiles
from twinweave.session import durable

#: Fixed value: bytes per MB.
MB = 1048576
PROGRESS = "query string, batch_id long, rows long, rows_per_s double"


def per_second(rows: Column, elapsed_us: Column) -> Column:
    """Rate in double arithmetic; null where no time has passed."""
    return rows.cast("double") / F.nullif(elapsed_us.cast("double") / F.lit(1e6), F.lit(0.0))


def operator_stats(df: DataFrame, by: Sequence[str], at_us: str, *, row_bytes: int | Column = 24, whole_rate: bool = False) -> DataFrame:
    """``rows, bytes, elapsed_us, rate`` of each operator replica; ``whole_rate`` rounds the rate down."""
    row_bytes = F.lit(row_bytes).cast("long") if isinstance(row_bytes, int) else row_bytes
    stats = df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(row_bytes).alias("bytes"), (F.max(at_us) - F.min(at_us)).alias("elapsed_us")
    )
    rate = per_second(F.col("rows"), F.col("elapsed_us"))
    return stats.withColumn("rate", F.floor(rate) if whole_rate else rate)


def throughput(stats: DataFrame, by: Sequence[str] = (), *, elapsed_us: Column | None = None) -> DataFrame:
    """Rows and MB per second over all sources: everything emitted, over the run's length
    (given, or that of the longest running source)."""
    length = F.max("elapsed_us") if elapsed_us is None else F.max(elapsed_us)
    return stats.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        per_second(F.sum("rows"), length).alias("rows_per_s"),
        (per_second(F.sum("bytes"), length) / F.lit(float(MB))).alias("mb_per_s"),
    )


def latency_summary(
    samples: DataFrame,
    value: str,
    by: Sequence[str],
    *,
    totals: DataFrame | None = None,
    method: str = "truncated",
) -> DataFrame:
    """``by..., total, samples, mean, 0, 5, 25, 50, 75, 95, 100`` of the sampled latencies.

    ``totals`` (``by..., total``) counts all values offered to the samplers; without it every
    value counts as sampled. Group by metric to merge the sinks, by sink to keep them apart.
    Groups without any value are left out.
    """
    by = list(by)
    samples = durable(samples.select(*by, value))  # evaluated once, read twice: for sketches and for counts
    stats = durable(group_statistics(samples, value, PERCENTILES, by))
    base = stats.select(*by, "samples", "mean", F.col("low").alias("0"), F.col("high").alias("100"))
    ranks = percentiles(samples, value, by=by, method=method, stats=stats)
    wide = ranks.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == F.lit(p), F.col("value"))).alias(str(int(round(p * 100)))) for p in PERCENTILES
    ])
    # One row per group and part, laid on top of each other: no join, so a constant group cannot make it a cross join.
    if totals is None:
        parts = base.withColumn("total", F.col("samples")).unionByName(wide, allowMissingColumns=True)
    else:
        offered = totals.where("total > 0").select(*by, "total")
        parts = base.unionByName(wide, allowMissingColumns=True).unionByName(offered, allowMissingColumns=True)
    names = ["total", "samples", "mean", *PERCENTILE_NAMES]
    merged = parts.groupBy(*by).agg(*[F.max(f"`{n}`").alias(n) for n in names])
    return merged.where("samples > 0 AND total > 0")


def merge_totals(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Offered values over all sinks of a metric."""
    return totals.groupBy(*by).agg(F.sum("total").alias("total")).where("total > 0")


class RunCounters:
    """Rows, bytes and event-time span of the operators of one run, observed as the rows pass: no job of their own.

    ``watch`` a DataFrame where an operator hands on its rows, run the last one, then read ``table``. In a stream the numbers of every micro-batch
    arrive by ``listener`` (register it with ``spark.streams.addListener``) and are added up. Tasks that run again after an executor was lost may count twice,
    as in Spark's own metrics.
    """

    _KIND = "operator string, rows long, bytes long, first_us long, last_us long"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._order: list[str] = []
        self._batch: dict[str, Observation] = {}
        self._streams: dict[str, list[tuple]] = {}
        self._lock = Lock()
        self.listener = _Observed(self)

    def watch(self, df: DataFrame, operator: str, *, at_us: str | Column | None = None, row_bytes: int | Column = 24) -> DataFrame:
        if operator in self._order:
            raise ValueError(f"{operator} is watched already")
        self._order.append(operator)
        at = as_long(0) if at_us is None else F.col(at_us) if isinstance(at_us, str) else at_us
        size = F.lit(row_bytes).cast("long") if isinstance(row_bytes, int) else row_bytes
        metrics = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.min(at).alias("first_us"), F.max(at).alias("last_us")]
        if df.isStreaming:
            self._streams[operator] = []
            return df.observe(operator, *metrics)
        self._batch[operator] = Observation(operator)
        return df.observe(self._batch[operator], *metrics)

    def table(self) -> DataFrame:
        """``operator, rows, bytes, first_us, last_us``, a row per watched operator."""
        with self._lock:
            rows = []
            for name in self._order:
                if name in self._batch:
                    seen = [tuple(self._batch[name].get[c] for c in ("rows", "bytes", "first_us", "last_us"))]
                else:
                    seen = self._streams[name]
                times = [[r[k] for r in seen if r[k] is not None] for k in (2, 3)]
                rows.append((name, sum(r[0] for r in seen), sum(r[1] or 0 for r in seen), min(times[0], default=None), max(times[1], default=None)))
        return self.spark.createDataFrame(rows, self._KIND)

    def _add(self, name: str, row) -> None:
        with self._lock:
            if name in self._streams:
                self._streams[name].append((row["rows"], row["bytes"], row["first_us"], row["last_us"]))


class _Observed(StreamingQueryListener):
    def __init__(self, counters: RunCounters):
        self.counters = counters

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.counters._add(name, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class ProgressLog(StreamingQueryListener):
    """Rows and rates of every micro-batch of the session's streaming queries, in a table below ``folder``.

    A query itself remembers its last 100 reports only. Reports are written as they come, ``every`` of them at a time, so a long run
    holds few in memory. Register with ``spark.streams.addListener``; ``table`` reads what there is.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 100):
        self.spark, self.folder, self.every = spark, folder, every
        self._held: list[tuple] = []
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            self._held.append((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond))
            if len(self._held) >= self.every:
                self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._flush()

    def _flush(self) -> None:
        held, self._held = self._held, []
        if held:
            self.spark.createDataFrame(held, PROGRESS).coalesce(1).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        """``query, batch_id, rows, rows_per_s``; a batch without input may report more than once."""
        with self._lock:
            self._flush()
        return self.spark.read.schema(PROGRESS).parquet(self.folder)
