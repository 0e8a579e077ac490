"""Key statistics, loads, stored results."""

import json
import time

import pytest
from pyspark.sql import functions as F

from twinweave import sinks
from twinweave.operators import accounting, skew
from twinweave.operators.joins import interval_join, numeric_pair
from twinweave.plans import report
from twinweave.plans.experiments import result_record
from twinweave.sources import results
from twinweave.sources.live import file_stream


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def sorted_rows(df):
    return sorted(rows_of(df))


@pytest.fixture(scope="module")
def freq(spark):
    a = spark.createDataFrame([(0,)] * 60 + [(1,)] * 5, "key long")
    b = spark.createDataFrame([(0,)] * 5 + [(2,)] * 30 + [(None,)], "key long")
    return skew.key_frequency(a, b, "key", 4)


def test_frequency_keeps_keys_without_rows(freq):
    assert sorted(rows_of(freq)) == [(0, 65, 0.65), (1, 5, 0.05), (2, 30, 0.3), (3, 0, 0.0)]
    assert [r[0] for r in rows_of(skew.by_probability(freq, "key"))] == [0, 2, 1, 3]
    assert rows_of(skew.heaviest(freq, "key")) == [(0, 65, 0.65)]


def test_splits_and_loads(freq):
    splits = skew.with_splits(freq, 4, 1.2, 3)
    assert sorted((r["key"], r["splits"]) for r in splits.collect()) == [(0, 3), (1, 1), (2, 1), (3, 1)]
    assert rows_of(skew.split_summary(splits, 3)) == [(1.5, 3, False)]
    assert rows_of(skew.split_summary(splits, 1)) == [(1.5, 3, True)]
    placed = skew.placement(splits, "key", 4)
    loads = {r["worker"]: r["load"] for r in skew.worker_load(placed, 4).collect()}
    part = 0.65 / 3
    assert loads == pytest.approx({0: part, 1: part + 0.05, 2: part + 0.3, 3: 0.0})
    balance = skew.load_balance(skew.worker_load(placed, 4)).first()
    assert balance["balance"] == pytest.approx((part + 0.3) / 0.25) and balance["all_loaded"] is False
    assert skew.least_loaded(skew.worker_load(placed, 4)).first()["worker"] == 3
    held = [(r["worker"], r["key"]) for r in skew.worker_keys(placed, "key", 5).collect()]
    assert held == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 2), (3, 3), (4, None)]


def test_number_of_hot_cells_is_bounded(spark):
    load = spark.range(1000).select(F.col("id").alias("cell"), (1.0 / (F.col("id") + 1)).alias("load"))
    for workers in (16, 64, 256):
        hot = skew.hot_cells(load, ["cell"], workers, 1.2)
        assert hot is not None and hot.count() < workers / 1.2
        assert hot.agg(F.max("splits")).first()[0] <= workers
    flat = spark.range(1000).select(F.col("id").alias("cell"), F.lit(1.0).alias("load"))
    assert skew.hot_cells(flat, ["cell"], 64, 1.2) is None


def test_run_counters(spark, tmp_path):
    """Rows in and out of each operator of a batch and of a stream, from the run itself."""
    rows = spark.createDataFrame([(1 + i % 3, i, i * 10) for i in range(30)], "key long, value long, ts long")
    counters = accounting.RunCounters(spark)
    left, right = counters.watch(rows, "left", at_us="ts"), counters.watch(rows.where("value < 12"), "right", at_us="ts")
    joined = counters.watch(interval_join(left, right, "key", "ts", "ts", 0, 30, select=numeric_pair(), strategy="bucket"), "join")
    with pytest.raises(ValueError):
        counters.watch(rows, "left")
    n = len(joined.collect())
    assert [tuple(r) for r in counters.table().select("operator", "rows", "bytes", "first_us", "last_us").collect()] == [
        ("left", 30, 720, 0, 290), ("right", 12, 288, 0, 110), ("join", n, 24 * n, 0, 0)]

    stream = accounting.RunCounters(spark)
    spark.streams.addListener(stream.listener)
    for k in range(3):
        rows.where(F.col("value") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = stream.watch(file_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1), "source")
    out = stream.watch(read.where("value % 2 = 0"), "filter", row_bytes=10)
    out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    time.sleep(2)
    spark.streams.removeListener(stream.listener)
    assert [tuple(r)[:3] for r in stream.table().collect()] == [("source", 30, 720), ("filter", 15, 150)]


def test_throughput_and_rates(spark):
    df = spark.createDataFrame([("s", 0, 0), ("s", 0, 2_000_000), ("s", 1, 0), ("s", 1, 1_000_000), ("t", 0, 5)], "op string, replica long, at long")
    stats = accounting.operator_stats(df, ["op", "replica"], "at", row_bytes=1048576)
    got = {(r["op"], r["replica"]): (r["rows"], r["bytes"], r["rate"]) for r in stats.collect()}
    assert got == {("s", 0): (2, 2097152, 1.0), ("s", 1): (2, 2097152, 2.0), ("t", 0): (1, 1048576, None)}
    total = accounting.throughput(stats).first()
    assert (total["rows"], total["rows_per_s"], total["mb_per_s"]) == (5, 2.5, 2.5)


def test_result_record_of_a_run(spark):
    latencies = spark.createDataFrame([(s, i * 1_000_000_000, float(i)) for s in range(2) for i in range(10)], "sink_id long, at_ns long, latency_us double")
    row = result_record(latencies, rate=0.5).first()
    assert row["total"] == 20 and row["samples"] == 10 and row["0"] == 0.0


def test_result_record_counts_from_the_start_of_the_run(spark):
    """5,000 latencies in a second at 250 samples per second, in unix time."""
    start = 1_704_106_800_000_000_000
    latencies = spark.range(5000).selectExpr("0L AS sink_id", f"{start}L + id * 200000 AS at_ns", "CAST(id AS DOUBLE) AS latency_us")
    row = result_record(latencies, rate=250).first()
    assert row["total"] == 5000 and 249 <= row["samples"] <= 251
    given = result_record(latencies, rate=250, epoch=start).first()
    assert given["samples"] == row["samples"]


RECORD = {"total": 10, "samples": 5, "mean": 2000.0, "0": 1.0, "5": 1.0, "25": 2.0, "50": 3.0, "75": 4.0, "95": 5.0, "100": 6.0}


def test_result_tree(spark, tmp_path):
    for i, p in enumerate((2, 16, 8), start=1):
        folder = tmp_path / "su" / "kp" / "50_keys" / "32_batch" / "1_source" / f"{i}_test_{p}"
        folder.mkdir(parents=True)
        (folder / "latency.json").write_text(json.dumps([dict(RECORD, mean=1000.0 * p), dict(RECORD, mean=3000.0 * p)], indent=2))
        (folder / "throughput.json").write_text(f"[{100 * p},\n {100 * p + 20}]")
    metrics = results.read_metrics(spark, str(tmp_path), name="latency.json")
    rates = results.read_throughput(spark, str(tmp_path), name="throughput.json")
    config = ["batch", "source_degree", "parallelism"]
    got = sorted(rows_of(report.config_averages(metrics, rates, config)))
    assert got == [(32, 1, p, 2.0 * p, 100.0 * p + 10) for p in (2, 8, 16)]
    average = {r["parallelism"]: (r["p50"], r["mean_ms"]) for r in report.run_average(metrics, ["parallelism"]).collect()}
    assert average == {p: (0.003, 2.0 * p) for p in (2, 8, 16)}
    spread = {r["parallelism"]: r["std_throughput"] for r in report.throughput_spread(rates, ["parallelism"]).collect()}
    assert spread == {2: 10.0, 8: 10.0, 16: 10.0}
    labels = report.in_label_order(rates.select(F.col("parallelism").cast("string").alias("label")).distinct(), "label")
    assert [r[0] for r in labels.collect()] == ["2", "8", "16"]


def test_broken_result_file_fails(spark, tmp_path):
    (tmp_path / "latency.json").write_text("{broken")
    with pytest.raises(Exception):
        results.read_metrics(spark, str(tmp_path)).collect()


def test_comparison_needs_all_variants(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 5.0), (1, "x", 3.0)], "p long, variant string, v double")
    assert rows_of(report.comparison(df, "p", "variant", ["x", "y"], "v")) == [(1, 2.0, 2.0)]


def test_log_files(spark, tmp_path):
    (tmp_path / "output-i5000-k2_t1.log").write_text("start\nMeasured throughput: 10.5 tuples/second\nnoise 7\nMeasured throughput: 2\nMeasured throughput: 1.2345678E7\n")
    row = results.log_throughput(spark, str(tmp_path)).first()
    assert row["throughput"] == 12345690.5
    from twinweave.functions.text import with_run_fields
    found = with_run_fields(results.log_throughput(spark, str(tmp_path)), "path", "interval", "keys", "repetition").first()
    assert (found["interval"], found["keys"], found["repetition"]) == (5000, 2, 1)


def test_sinks_append(spark, tmp_path):
    record = spark.createDataFrame([(7, 3.5)], "total long, mean double")
    for run in ("first", "second"):
        assert sinks.append_metrics(record, str(tmp_path / "m"), run) == 1
        sinks.append_throughput(spark.createDataFrame([(9.9,)], "throughput double"), str(tmp_path / "t"), run)
    assert sorted_rows(sinks.read_appended(spark, str(tmp_path / "m"), record.schema)) == [("first", 7, 3.5), ("second", 7, 3.5)]
    assert sorted_rows(sinks.read_appended(spark, str(tmp_path / "t"), "throughput long")) == [("first", 9), ("second", 9)]
    # a repeated append, one that broke before it was published, and one that holds a run that is there and a new one
    assert sinks.append_metrics(record.withColumn("total", F.lit(8).cast("long")), str(tmp_path / "m"), "first") == 0
    record.withColumn("run_id", F.lit("third")).write.partitionBy("run_id").json(str(tmp_path / "m" / "data" / "attempt=broken"))
    both = spark.createDataFrame([(1, 1.5, "second"), (2, 2.5, "fourth")], "total long, mean double, run string")
    assert sinks.append_metrics(both, str(tmp_path / "m"), "run") == 1
    assert sorted_rows(sinks.read_appended(spark, str(tmp_path / "m"), record.schema)) == [("first", 7, 3.5), ("fourth", 2, 2.5), ("second", 7, 3.5)]
    assert sinks.append_metrics(record.limit(0), str(tmp_path / "m"), "none") == 0
    pairs = spark.createDataFrame([("k", 3, 1999)], "key string, value long, event_us long")
    sinks.write_pairs(pairs, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).first()[0] == "k\t3\t1"
