"""Lateness judged row by row, in the order of arrival.

A streaming join judges lateness once per micro-batch, by the watermark of the batch before. Engines that work row by row move their watermark with every row:
a row is late if its time lies more than the delay before the greatest time that each source has shown up to then (the least of
these, as the slower source holds the watermark back). That is a running maximum per source over the rows in order of arrival, which needs no
row-by-row program: it is scanned in blocks like a running total, and only the maxima are carried from batch to batch.

``admit`` runs a stream into a folder of rows that are on time, beside the late ones and the state. Joins read that folder as a stream, all files of a
batch in one micro-batch: then their own watermarks are never ahead of the ones used here, so they drop nothing more. The files of a batch are
in no order, so a limit of files per micro-batch would let rows of one file make those of the next late.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from twinweave.functions.integers import as_long
from twinweave.operators.scan import BLOCK_ROWS, running_greatest

_STATE = "source string, latest_us long, admitted long, dropped long"


def judged(rows: DataFrame, sources: Sequence[str], *, source: str, at_us: str, arrival: str, delay_us: int = 0, latest: dict[str, int | None] | None = None,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``late``; ``arrival`` is a unique whole number in order of arrival, ``latest`` the greatest time of each source before these rows."""
    marked, names = rows, [f"_latest_{k}" for k in range(len(sources))]
    for name, one in zip(names, sources):
        marked = running_greatest(marked, F.when(F.col(source) == one, F.col(at_us)), arrival, name, exclusive=True, block_rows=block_rows)
        before = (latest or {}).get(one)
        if before is not None:
            marked = marked.withColumn(name, F.greatest(F.col(name), as_long(before)))
    # while a source has shown nothing there is no watermark
    known = F.lit(True)
    for name in names:
        known = known & F.col(name).isNotNull()
    watermark = F.least(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    return marked.withColumn("late", known & (F.col(at_us) < watermark - as_long(delay_us))).drop(*names)


def admit(stream: DataFrame, folder: str, sources: Sequence[str], *, source: str, at_us: str, arrival: str, delay_us: int = 0, block_rows: int = BLOCK_ROWS,
          available_now: bool = False) -> StreamingQuery:
    """Write the rows of ``stream`` that are on time to ``folder/admitted``, the late ones to ``folder/late``, and the state of each batch.

    ``source`` names the source of a row, one of ``sources`` (a few). A batch that is repeated starts from the state before it and replaces its files.
    """
    if not sources:
        raise ValueError("at least one source is needed")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = {} if batch_id == 0 else {r["source"]: r for r in spark.read.schema(_STATE).parquet(f"{folder}/state/batch={batch_id - 1}").collect()}
        rows = judged(batch, sources, source=source, at_us=at_us, arrival=arrival, delay_us=delay_us, block_rows=block_rows,
                      latest={s: r["latest_us"] for s, r in before.items()}).persist(StorageLevel.DISK_ONLY)
        rows.where("NOT late").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/admitted/batch={batch_id}")
        rows.where("late").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        found = {r["s"]: r for r in rows.groupBy(F.col(source).alias("s")).agg(
            F.max(at_us).alias("t"), F.count_if(~F.col("late")).alias("kept"), F.count_if(F.col("late")).alias("gone")).collect() if r["s"] in sources}  # a row per source
        state = []
        for s in sources:
            old, new = before.get(s), found.get(s)
            times = [r[k] for r, k in ((old, "latest_us"), (new, "t")) if r is not None and r[k] is not None]
            state.append((s, max(times, default=None), (old["admitted"] if old else 0) + (new["kept"] if new else 0), (old["dropped"] if old else 0) + (new["gone"] if new else 0)))
        spark.createDataFrame(state, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        rows.unpersist()

    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """``source, latest_us, admitted, dropped`` after the last batch."""
    tables = spark.read.schema(_STATE + ", batch long").parquet(f"{folder}/state")
    return tables.where(F.col("batch") == tables.agg(F.max("batch")).scalar()).drop("batch")
