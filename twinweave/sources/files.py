"""Readers and writers of ``|``-separated dataset files.

A synthetic file starts with one header line ``num_keys|size`` and has rows ``key|offset_ms``;
the other two kinds have no header. Bad rows fail the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from twinweave.functions import draws, text
from twinweave.functions.integers import as_long
from twinweave.model import CONSTANT_VALUE
from twinweave.session import durable


#: Splits of an input up to which their table is broadcast (a path and three numbers each); beyond it lines are joined to it by a shuffle.
MOST_SPLITS = 200_000


def split_starts(lines: DataFrame) -> DataFrame:
    """``path, split, first, lines, line_start, row_start, file_no``: per split the running id of its first line, how many lines it has,
    how many come before it in the file and in the whole input, and how many files with lines do. A row per split; the text is read but nothing of it moves."""
    splits = durable(lines.groupBy("path", "split").agg(F.min("seen").alias("first"), F.count("*").alias("lines")))
    files = splits.groupBy("path").agg(F.sum("lines").alias("file_lines"))
    before = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    files = files.select(F.col("path").alias("file"), F.coalesce(F.sum("file_lines").over(before), F.lit(0)).alias("file_start"), F.count("*").over(before).alias("file_no"))
    in_file = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    placed = splits.withColumn("line_start", F.coalesce(F.sum("lines").over(in_file), F.lit(0)))
    return durable(placed.join(files, F.col("path") == F.col("file")).select("path", "split", "first", "lines", "line_start", (F.col("file_start") + F.col("line_start")).alias("row_start"), "file_no"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, row_id, file_no, line``: text lines with their place in the file and in the whole input, and their file's place (from 0).

    Files follow each other in path order. A file is read in splits by many tasks. A line's place in its split is its running id less that of the
    split's first line, so lines stay where they are read; only the small table of splits is joined to them. Should the
    two scans cut the input differently, the query fails rather than give wrong places.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seen"),
        F.col("value").alias("line"),
    )
    starts = split_starts(lines).withColumnsRenamed({"path": "_path", "split": "_split"})
    if starts.count() <= MOST_SPLITS:
        starts = F.broadcast(starts)
    place = F.col("seen") - F.col("first")
    same = F.when((place >= 0) & (place < F.col("lines")), place).otherwise(F.raise_error(F.lit("the input was cut differently when it was read again")).cast("long"))
    placed = lines.join(starts, (F.col("path") == F.col("_path")) & (F.col("split") == F.col("_split")), "left").withColumn("place", same)
    return placed.select("path", (F.col("line_start") + F.col("place")).alias("line_no"), (F.col("row_start") + F.col("place")).alias("row_id"), "file_no", "line")


def _fields(line: Column, count: int, kind: str) -> Column:
    found = text.fields(line)
    return F.when(F.size(found) == count, found).otherwise(
        F.raise_error(F.concat(F.lit(f"not a {kind} row: "), line)).cast("array<string>")
    )


#: Bytes of a file in which its header line must end.
HEADER_BYTES = 256


def first_lines(spark: SparkSession, path: str) -> list[str]:
    """The first line of every file of the input, read by opening each file for a few bytes; hidden files are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found = []
    for status in store.listStatus(folder):
        if status.isDirectory() or (status.getPath().getName()[:1] in "_." and status.getPath() != folder):
            continue
        codec, stream, line = codecs.getCodec(status.getPath()), store.open(status.getPath()), bytearray()
        try:
            stream = codec.createInputStream(stream) if codec is not None else stream
            while len(line) < HEADER_BYTES and (byte := stream.read()) not in (-1, 10):
                line.append(byte)
        finally:
            stream.close()
        if line:  # an empty part has no header
            found.append(line.decode("utf-8", "replace").rstrip("\r"))
    return found


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """``num_keys, size`` from the first line of every file of the input (one row if they agree). What is read does not grow with the files."""
    first = spark.createDataFrame([(line,) for line in sorted(set(first_lines(spark, path)))], "line string")
    parts = _fields(F.col("line"), 2, "header")
    return first.select(text.to_long(parts[0]).alias("num_keys"), text.to_long(parts[1]).alias("size")).distinct()


def check_same_keys(header_a: DataFrame, header_b: DataFrame) -> DataFrame:
    """``num_keys, size_a, size_b`` of two inputs; fails unless both declare the same number of keys."""
    a = header_a.agg(F.min("num_keys").alias("keys_a"), F.max("num_keys").alias("top_a"), F.sum("size").alias("size_a"))
    b = header_b.agg(F.min("num_keys").alias("keys_b"), F.max("num_keys").alias("top_b"), F.sum("size").alias("size_b"))
    both = a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])
    same = (F.col("keys_a") == F.col("top_a")) & (F.col("keys_b") == F.col("top_b")) & (F.col("keys_a") == F.col("keys_b"))
    return both.select(
        F.when(same, F.col("keys_a")).otherwise(F.raise_error(F.lit("the inputs declare different numbers of keys")).cast("long")).alias("num_keys"),
        "size_a", "size_b",
    )


def normalise(df: DataFrame, key_base: int = 0, value: int | str | Column | None = None, seed: int = 0) -> DataFrame:
    """Shift keys down by ``key_base`` and set values.

    ``value``: a number, a column, ``"hash"`` for 1..100 drawn from the row id, or None to keep the file's value.
    """
    df = df.withColumn("key", F.col("key") - as_long(key_base))
    if value is None:
        return df
    if isinstance(value, str) and value == "hash":
        value = draws.uniform_int(draws.unit_draw(F.col("row_id"), seed, stream=2), 1, 100)
    return df.withColumn("value", as_long(value))


def read_synthetic(
    spark: SparkSession, path: str, *, key_base: int = 1, value: int | str | Column | None = "hash", seed: int = 0
) -> DataFrame:
    """``row_id, key, value, ts_off`` of a synthetic dataset, its header lines and blank lines left out.

    Rows count from 1 and headers do not count, so a dataset has the same ids whether it lies in one file or in many.
    """
    rows = numbered_lines(spark, path).where((F.col("line_no") > 0) & ~text.is_blank(F.col("line")))
    parts = _fields(F.col("line"), 2, "synthetic")
    rows = rows.select((F.col("row_id") - F.col("file_no")).alias("row_id"), text.to_long(parts[0]).alias("key"), F.lit(CONSTANT_VALUE).cast("long").alias("value"),
                       text.to_long(parts[1]).alias("ts_off"))
    return normalise(rows, key_base, value, seed)


def _read_plain(spark: SparkSession, path: str, count: int, key_at: int, value_at: int, kind: str) -> DataFrame:
    rows = numbered_lines(spark, path).where(~text.is_blank(F.col("line")))
    parts = _fields(F.col("line"), count, kind)
    return rows.select("row_id", text.to_long(parts[key_at]).alias("key"), text.to_long(parts[value_at]).alias("value"),
                       F.lit(0).cast("long").alias("ts_off"))


def read_rovio(spark: SparkSession, path: str, *, key_base: int = 0, value: int | str | Column | None = None) -> DataFrame:
    """Four fields: the first is the key, the third the value; no time offset."""
    return normalise(_read_plain(spark, path, 4, 0, 2, "rovio"), key_base, value)


def read_stock(spark: SparkSession, path: str, *, key_base: int = 0, value: int | str | Column | None = None) -> DataFrame:
    """Two fields: key and value; no time offset."""
    return normalise(_read_plain(spark, path, 2, 0, 1, "stock"), key_base, value)


def read_pair(reader: Callable[..., DataFrame], spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Both inputs, the second from the partner path of the first."""
    return reader(spark, path, **options), reader(spark, text.partner_path(path), **options)


def _in_row_order(df: DataFrame, files: int | None) -> DataFrame:
    """Range-partitioned by row id: part files follow each other. Without ``files`` their number grows with the data."""
    parts = df.repartitionByRange(files, "row_id") if files else df.repartitionByRange("row_id")
    return parts.sortWithinPartitions("row_id")


def write_synthetic(df: DataFrame, path: str, num_keys: int, size: int, *, files: int | None = None) -> None:
    """Write ``row_id, key, ts_off`` as a folder of synthetic files that follow each other in row order.

    Every file carries the header line, written as a column header of the same two numbers.
    """
    columns, names = ["key", "ts_off"], [str(num_keys), str(size)]
    if num_keys == size:
        # a table has no two columns of one name, so this header is one column of its own
        line = F.concat_ws(text.SEPARATOR, *columns)
        rows = _in_row_order(df, files).select(line.alias(f"{num_keys}{text.SEPARATOR}{size}"))
        # quoting would set the separator inside the one column in quotes
        rows.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)
        return
    (
        _in_row_order(df, files)
        .select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
        .write.mode("errorifexists").option("sep", text.SEPARATOR).option("header", True).csv(path)
    )


def write_lines(df: DataFrame, path: str, columns: list[str], *, files: int | None = None) -> None:
    """Write ``columns`` of each row separated by ``|`` without a header, in ``row_id`` order."""
    (
        _in_row_order(df, files).select(*columns)
        .write.mode("errorifexists").option("sep", text.SEPARATOR).csv(path)
    )
