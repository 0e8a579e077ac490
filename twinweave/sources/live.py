"""Unbounded sources for Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from twinweave import model
from twinweave.functions import draws
from twinweave.functions.clock import ntz_micros
from twinweave.functions.integers import as_long
from twinweave.sources.timeline import position_in_pass


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, *, name: str | None = None, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Files of ``folder`` as a stream, a limited number of them per micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def event_column(df: DataFrame, ts: str, out: str = "event_time") -> DataFrame:
    """``ts`` as the one timestamp column ``out`` a watermark can be set on."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return df.withColumn(out, F.timestamp_micros(ntz_micros(ts))).drop(*({ts} - {out}))
    return df.withColumn(out, F.col(ts).cast("timestamp")).drop(*({ts} - {out}))


def paced_replay(spark: SparkSession, dataset: DataFrame, rows: int, span_ms: int, rate: int) -> DataFrame:
    """A dataset with ``row_id`` 0..rows-1 and ``event_us`` played over and over at ``rate`` rows per second.

    ``span_ms`` is how long one pass lasts in event time. ``ingest_ns`` is when the row was drawn.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    ticks = position_in_pass(ticks, as_long(rows)).withColumn("ingest_ns", F.unix_micros("timestamp") * as_long(1000)).drop("timestamp", "value")
    played = ticks.join(dataset, "row_id")
    return played.withColumn("event_us", F.col("event_us") + F.col("pass") * as_long(span_ms * 1000))


def live_random(spark: SparkSession, num_keys: int, rate: int, *, seed: int = model.SEED_A, replicas: int = 1, base_ms: int = model.EVENT_TIME_BASE_MS) -> DataFrame:
    """The random source at ``rate`` rows per second: ``replica, row_id, key, value, event_us, ingest_ns``, drawn for ever.

    Every replica has its own clock, which the query keeps as state: the first event at ``base_ms``, gaps of 0..499 ms after
    each event. Keys and gaps are hashed from the running number of the row, so a batch that runs again draws the
    same. A replica is one task per batch, as its times follow from each other.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    number = F.col("value")
    drawn = ticks.select(
        F.pmod(number, as_long(replicas)).alias("replica"), number.alias("row_id"),
        draws.uniform_int(draws.unit_draw(number, seed, 0), 1, num_keys).alias("key"), draws.uniform_int(draws.unit_draw(number, seed, 1), 0, 499).alias("gap"),
        (F.unix_micros("timestamp") * as_long(1000)).alias("ingest_ns"))

    def timed(key, parts, state):
        import pandas as pd

        rows = pd.concat(list(parts)).sort_values("row_id")
        clock = state.get[0] if state.exists else base_ms
        after = clock + rows["gap"].cumsum()
        state.update((int(after.iloc[-1]),))
        yield pd.DataFrame({"replica": rows["replica"], "row_id": rows["row_id"], "key": rows["key"], "value": model.CONSTANT_VALUE,
                            "event_us": (after - rows["gap"]) * 1000, "ingest_ns": rows["ingest_ns"]})

    return drawn.groupBy("replica").applyInPandasWithState(
        timed, "replica long, row_id long, key long, value long, event_us long, ingest_ns long", "clock long", "append", "NoTimeout")
