"""Readers of stored results: metric arrays, throughput arrays, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinweave.functions.text import with_run_fields
from twinweave.model import METRIC_RESULT

#: Fixed value: how a run log reports its throughput.
THROUGHPUT_LINE = r"Measured throughput: ([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def read_metrics(spark: SparkSession, root: str, *, name: str = "*.json", layout: str = "array") -> DataFrame:
    """All metric records below ``root`` with ``path`` and the fields coded in folder names.

    ``layout``: ``array`` for files that hold one JSON array, ``lines`` for one record per line.
    """
    reader = spark.read.schema(METRIC_RESULT).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("mode", "FAILFAST")
    found = reader.json(root, multiLine=(layout == "array"))
    return with_run_fields(found.select("*", F.col("_metadata.file_path").alias("path")), "path")


def read_throughput(spark: SparkSession, root: str, *, name: str = "throughput*") -> DataFrame:
    """``throughput`` numbers of JSON integer arrays below ``root``, one row each, with ``path`` and its fields."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    numbers = F.from_json("value", "array<bigint>", {"mode": "FAILFAST"})
    return with_run_fields(files.select("path", F.explode(numbers).alias("throughput")), "path")


def log_throughput(spark: SparkSession, path: str) -> DataFrame:
    """``path, throughput``: the sum of all throughput numbers a run log reports."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    found = lines.where(F.col("value").rlike(THROUGHPUT_LINE))
    return found.groupBy("path").agg(F.sum(F.regexp_extract("value", THROUGHPUT_LINE, 1).cast("double")).alias("throughput"))
