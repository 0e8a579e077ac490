"""Running streaming queries: to the end of what is there, or for a fixed time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from twinweave.operators.sampling import rate_sample
from twinweave.session import fresh_dir
from twinweave.streaming.splits import SplitLog


def run_available_now(df: DataFrame, label: str = "stream", *, folder: str | None = None, splits: SplitLog | None = None,
                      state_tasks: int | None = None) -> DataFrame:
    """Process all input there is, in as many micro-batches as the source gives, and read the result back.

    ``splits`` is the log the query's join was built with; it is tied to the checkpoint. ``state_tasks`` is over how many tasks
    state is dealt (default: the shuffle partitions). Every task commits its stores in every micro-batch, whatever is in them. The
    first run decides: the number is kept in the checkpoint, and later runs go on with it."""
    folder = folder or fresh_dir(df.sparkSession, label)
    if splits is not None:
        splits.bind(f"{folder}/checkpoint")
    writer = (
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
        .trigger(availableNow=True)
    )
    query = writer.start() if state_tasks is None else _started(writer, df.sparkSession, state_tasks)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def _started(writer: DataStreamWriter, spark: SparkSession, state_tasks: int) -> StreamingQuery:
    """A query takes the settings its session has when it starts, and keeps them."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(state_tasks))
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def run_until_idle(df: DataFrame, folder: str) -> DataFrame:
    """Process batch after batch until the source has no more for now, stop, and read back all that this and earlier runs in ``folder`` wrote."""
    query = (
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def run_for(query: StreamingQuery, seconds: float) -> None:
    """Let a query run for a fixed time, then stop it."""
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()


def live_latency_us(ingest_ns: Column) -> Column:
    """Age of a joined row at the time of its micro-batch, in whole us."""
    return F.unix_micros(F.current_timestamp()) - F.call_function("div", ingest_ns, F.lit(1000).cast("long"))


_STATE = "sink long, epoch long, taken long, total long"


def sample_stream(df: DataFrame, folder: str, *, sink: str, at: str | Column, rate: float, order: list[str], epoch: int | None = None,
                  ticks_per_second: int = 1_000_000_000, prepare: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = False) -> StreamingQuery:
    """Run a stream into a sampling sink: what the sampler of each ``sink`` (a whole number) keeps is appended to ``folder``, everything is counted.

    The samplers' clocks and counts are carried from batch to batch, and over restarts, by a small table per batch: a row per sink with the time its
    sampler was made (``epoch``, or the first time it saw), and how many rows it took and was offered. A batch that is repeated
    starts from the table of the batch before and replaces its own files. ``at`` counts ``ticks_per_second``; ``order`` breaks its ties. ``prepare`` is applied to a batch first.
    ``samples`` and ``sampled`` read the result.
    """
    at = F.col(at) if isinstance(at, str) else at

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = prepare(batch) if prepare is not None else batch
        rows = batch.withColumns({"_at": at.cast("long"), "_by": F.col(sink).cast("long")}).persist(StorageLevel.DISK_ONLY)
        before = spark.read.schema(_STATE).parquet(f"{folder}/state/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], _STATE)
        first = rows.groupBy(F.col("_by").alias("sink")).agg(F.min("_at").alias("seen"), F.count("*").alias("n"))
        begun = before.join(first, "sink", "full").select(
            "sink", F.coalesce("epoch", F.lit(epoch).cast("long"), "seen").alias("epoch"), F.coalesce("taken", F.lit(0)).alias("taken"),
            (F.coalesce("total", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("total"))
        begun = begun.persist(StorageLevel.DISK_ONLY)
        known = rows.join(begun.select(F.col("sink").alias("_sink_"), F.col("epoch").alias("_epoch"), F.col("taken").alias("_taken")), F.col("_by") == F.col("_sink_"))
        kept = rate_sample(known, sink="_by", at="_at", rate=rate, epoch=F.col("_epoch"), order=order, ticks_per_second=ticks_per_second, taken=F.col("_taken"))
        kept.select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/samples/batch={batch_id}")
        mine = spark.read.schema(batch.schema).parquet(f"{folder}/samples/batch={batch_id}").groupBy(F.col(sink).cast("long").alias("sink")).agg(F.count("*").alias("more"))
        after = begun.join(mine, "sink", "left").select("sink", "epoch", (F.col("taken") + F.coalesce("more", F.lit(0))).alias("taken"), "total")
        after.write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        rows.unpersist()
        begun.unpersist()

    writer = df.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def samples(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows that the samplers of ``sample_stream`` have kept."""
    return spark.read.schema(schema).parquet(f"{folder}/samples").select(*schema.names)


def sampled(spark: SparkSession, folder: str) -> DataFrame:
    """``sink, epoch, taken, total`` after the last batch."""
    tables = spark.read.schema(_STATE + ", batch long").parquet(f"{folder}/state")
    return tables.where(F.col("batch") == tables.agg(F.max("batch")).scalar()).drop("batch")


def sample_latency(df: DataFrame, ingest_ns: str, folder: str, sink_id: int = 0, *, rate: float = 0, available_now: bool = False) -> StreamingQuery:
    """Append ``sink_id, at_ns, latency_us`` of joined rows to ``folder``, batch by batch, at most ``rate`` a second (0: all).

    The time of a row is that of its micro-batch. How many rows there were in all is what ``sampled`` says.
    """
    def stamped(batch: DataFrame) -> DataFrame:
        return batch.select(
            F.lit(sink_id).cast("long").alias("sink_id"),
            (F.unix_micros(F.current_timestamp()) * 1000).alias("at_ns"),
            live_latency_us(F.col(ingest_ns)).cast("double").alias("latency_us"),
        )

    return sample_stream(df, folder, sink="sink_id", at="at_ns", rate=rate, order=["latency_us"], prepare=stamped, available_now=available_now)
