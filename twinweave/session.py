"""Session set-up and the shared folder that durable intermediate data goes to."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library is written for.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # sort-merge joins become hash joins where every shuffled partition is known to be small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # join state outgrows the heap long before it outgrows local disks
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def get_session(app: str = "twinweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, never a machine-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="twinweave-"))
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; it is deleted when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_discard)
    _made.append(path)
    return path


_made: list[str] = []


def _discard() -> None:
    """Delete the folders this process has made, as far as its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made:
        folder = hadoop(path)
        folder.getFileSystem(conf).delete(folder, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there on.

    For inputs that are costly and read several times, and for columns that are only
    stable within one run of a shuffle (the partition number after a range
    partitioning). A table rather than a checkpoint: its size is known, so Spark
    decides for or against a broadcast by that.
    """
    folder = fresh_dir(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def task_slots(spark: SparkSession) -> int:
    """Number of reduce tasks a shuffle aims at: what a load has to be spread over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
