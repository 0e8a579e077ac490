"""Outputs: joined rows, metric records, sampled latencies, throughput numbers.

Results are appended to folders, one partition per run. An append writes the files of an *attempt* first and
then one line of a manifest, which publishes the runs in it. Readers look at published attempts only, and at the first of each run: a broken
append leaves nothing to be seen, a repeated one no second copy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from twinweave.functions.integers import trunc_div
from twinweave.session import durable


def pair_line(key: str = "key", value: str = "value", event_us: str = "event_us") -> Column:
    """Key, value and event time in ms, separated by tabs."""
    return F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string"), trunc_div(F.col(event_us), 1000).cast("string"))


def write_pairs(df: DataFrame, path: str, **columns: str) -> None:
    df.select(pair_line(**columns).alias("line")).write.mode("append").text(path)


def print_pairs(df: DataFrame, **columns: str):
    """Start printing the joined rows of a stream to the console."""
    return df.select(pair_line(**columns).alias("line")).writeStream.format("console").outputMode("append").start()


def append_metrics(df: DataFrame, path: str, run_id: str | Column = "run_id") -> int:
    """Append result records as JSON lines, by run. How many runs were published: those that are there already stay as they are."""
    return _append(df, path, run_id)


def append_throughput(df: DataFrame, path: str, run_id: str | Column = "run_id") -> int:
    """Append throughput numbers, cut to whole rows per second, by run."""
    return _append(df.withColumn("throughput", F.col("throughput").cast("long")), path, run_id)


_MANIFEST = "run_id string, attempt string, published timestamp"


def _append(df: DataFrame, path: str, run_id: str | Column) -> int:
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    run = run_id if isinstance(run_id, Column) else F.col(run_id) if run_id in df.columns else F.lit(run_id)
    staged = f"{path.rstrip('/')}/data/attempt={attempt}"
    df.withColumn("run_id", run.cast("string")).write.partitionBy("run_id").json(staged)
    names = [f.name for f in df.schema if f.name != "run_id"]
    runs = spark.read.schema(df.select(*[f"`{n}`" for n in names]).schema).json(staged)
    new = runs.select(F.col("run_id").cast("string").alias("run_id")).distinct() if "run_id" in runs.columns else spark.createDataFrame([], "run_id string")
    new = durable(new.join(manifest(spark, path).select("run_id"), "run_id", "left_anti"))
    new.select("run_id", F.lit(attempt).alias("attempt"), F.current_timestamp().alias("published")).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")
    return new.count()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, attempt``: the attempt that published each run first."""
    place = f"{path.rstrip('/')}/manifest"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "run_id string, attempt string")
    rows = spark.read.schema(_MANIFEST).parquet(place)
    return rows.groupBy("run_id").agg(F.min_by("attempt", F.struct("published", "attempt")).alias("attempt"))


def read_appended(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The published records below ``path``: ``schema`` and ``run_id``."""
    wanted = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    inside = StructType([f for f in wanted if f.name != "run_id"])
    typed = StructType([*inside, StructField("attempt", StringType()), StructField("run_id", StringType())])
    rows = spark.read.schema(typed).option("basePath", f"{path.rstrip('/')}/data").json(f"{path.rstrip('/')}/data/*")
    return rows.join(manifest(spark, path), ["run_id", "attempt"], "left_semi").select("run_id", *[f"`{f.name}`" for f in inside])


def dump_latencies(df: DataFrame, path: str, value: str = "latency_us") -> None:
    """Every sampled latency as one CSV value per line."""
    df.select(value).write.mode("append").csv(path)
