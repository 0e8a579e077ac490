"""Sinks, stored results and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave import sinks
from twinweave.operators import accounting
from twinweave.operators.joins import interval_join, numeric_pair
from twinweave.plans import report
from twinweave.plans.catalog.registry import HOUR, click_view, events, query, sql
from twinweave.session import durable, fresh_dir
from twinweave.sources import results

DAY = 24 * HOUR
EPOCH_US = 1704067200000000


# Event types stand in for variants, users for configurations and ten-day spans for repeated
# runs: a configuration has three runs however large the tables are.
def _records(spark, sf):
    """One result record per parallelism and run, as a benchmark would have stored it."""
    rows = events(spark, sf).select(
        (F.col("user_id") % 5 + 1).alias("parallelism"), F.call_function("div", F.col("ts") - F.lit(EPOCH_US), F.lit(10 * DAY)).alias("run"), "amount")
    return accounting.latency_summary(rows, "amount", ["parallelism", "run"])


RECORDS = f"""runs AS (SELECT user_id % 5 + 1 AS parallelism, (ts - {EPOCH_US}) // {10 * DAY} AS run, amount FROM ev),
  ranked AS (SELECT parallelism, run, amount, row_number() OVER (PARTITION BY parallelism, run ORDER BY amount) - 1 AS k,
    count(*) OVER (PARTITION BY parallelism, run) AS n FROM runs),
  rec AS (SELECT parallelism, run, count(*) AS total, avg(amount) AS mean, min(amount) AS p0, max(amount) AS p100,
    {", ".join(f"max(CASE WHEN k = CAST(floor(n * {p}e0) AS BIGINT) THEN amount END) AS p{q}" for p, q in ((0.05, 5), (0.25, 25), (0.5, 50), (0.75, 75), (0.95, 95)))}
    FROM ranked GROUP BY parallelism, run)"""
NAMES = ("p0", "p5", "p25", "p50", "p75", "p95", "p100")


def _tree(df):
    """Folder names of the result tree."""
    return df.withColumns({
        "batch_dir": F.lit("32_batch"), "source_dir": F.lit("1_source"),
        "test_dir": F.concat(F.col("parallelism").cast("string"), F.lit("_test_"), F.col("parallelism").cast("string")),
    })


@query("a11_run_average", sql(f"""SELECT parallelism, {", ".join(f"round(avg({n} / 1000), 9) AS {n}" for n in NAMES)}, round(avg(mean / 1000), 9) AS mean_ms
  FROM rec GROUP BY parallelism""", RECORDS))
def run_average(spark, sf):
    averages = report.run_average(_records(spark, sf), ["parallelism"])
    return averages.withColumns({c: F.round(c, 9) for c in (*NAMES, "mean_ms")})


@query("a12_throughput_std", sql("SELECT parallelism, round(avg(total), 6) AS mean_throughput, round(stddev_pop(total), 6) AS std_throughput FROM rec GROUP BY parallelism", RECORDS))
def throughput_std(spark, sf):
    spread = report.throughput_spread(_records(spark, sf).withColumn("throughput", F.col("total")), ["parallelism"])
    return spread.withColumns({c: F.round(c, 6) for c in ("mean_throughput", "std_throughput")})


@query("a13_config_averages", sql("""SELECT 32::BIGINT AS batch, 1::BIGINT AS source_degree, parallelism, round(avg(mean) / 1000, 9) AS mean_ms, round(avg(total), 6) AS mean_throughput
  FROM rec GROUP BY parallelism""", RECORDS))
def config_averages(spark, sf):
    """Stored as a result tree, read back, configuration taken from folder names."""
    root = fresh_dir(spark, "results")
    records = durable(_tree(_records(spark, sf)))
    folders = ["batch_dir", "source_dir", "test_dir"]
    records.drop("parallelism", "run").write.partitionBy(*folders).json(f"{root}/latency")
    records.groupBy(*folders).agg(F.collect_list("total").alias("numbers")).select(
        *folders, F.to_json("numbers").alias("value")).write.partitionBy(*folders).text(f"{root}/throughput")
    config = ["batch", "source_degree", "parallelism"]
    found = report.config_averages(
        results.read_metrics(spark, f"{root}/latency", layout="lines"), results.read_throughput(spark, f"{root}/throughput", name="*.txt"), config)
    return found.withColumns({"mean_ms": F.round("mean_ms", 9), "mean_throughput": F.round("mean_throughput", 6)})


VARIANTS = ("click", "view", "purchase", "signup", "error")


@query("a14_comparison_pivot", sql(f"""SELECT parallelism, {", ".join(f"round({v}, 9) AS {v}" for v in VARIANTS)} FROM (
  SELECT user_id % 50 AS parallelism, {", ".join(f"avg(CASE WHEN event_type = '{v}' THEN amount END) AS {v}" for v in VARIANTS)} FROM ev GROUP BY 1)
  WHERE {" AND ".join(f"{v} IS NOT NULL" for v in VARIANTS)}"""))
def comparison_pivot(spark, sf):
    """All event types as variants."""
    wide = report.comparison(events(spark, sf).withColumn("parallelism", F.col("user_id") % 50), "parallelism", "event_type", VARIANTS, "amount")
    return wide.withColumns({v: F.round(v, 9) for v in VARIANTS})


@query("a15_log_throughput", sql("SELECT user_id % 4 AS run, round(sum(amount) + 12345678.0 * count(*), 3) AS throughput FROM ev GROUP BY 1"))
def log_throughput(spark, sf):
    """Run logs with other lines between the reported numbers, some of them written with an exponent."""
    folder = fresh_dir(spark, "logs")
    lines = events(spark, sf).select((F.col("user_id") % 4).alias("run"), F.explode(F.array(
        F.concat(F.lit("Measured throughput: "), F.col("amount").cast("string"), F.lit(" tuples/second")),
        F.lit("Measured throughput: 1.2345678E7 tuples/second"),
        F.concat(F.lit("[Sink] joined: "), F.col("value").cast("string")))).alias("value"))
    lines.write.partitionBy("run").text(folder)
    found = results.log_throughput(spark, folder)
    run = F.regexp_extract("path", r"run=(\d+)", 1).cast("long")
    return found.groupBy(run.alias("run")).agg(F.round(F.sum("throughput"), 3).alias("throughput"))


@query("o3_label_order", sql("""SELECT CAST(row_number() OVER (ORDER BY user_id) AS BIGINT) AS place, CAST(user_id AS VARCHAR) AS label, n
  FROM (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id)"""))
def label_order(spark, sf):
    """Numeric order of text labels; the place of a label is written out so that it can be compared."""
    labels = events(spark, sf).groupBy(F.col("user_id").cast("string").alias("label")).agg(F.count("*").alias("n"))
    return report.in_label_order(labels, "label").select((F.col("label").cast("long") + 1).alias("place"), "label", "n")


# --- sinks ------------------------------------------------------------------------

@query("k1_joined_lines", sql(f"""SELECT a.user_id || chr(9) || (a.value + b.value) || chr(9) || (GREATEST(a.ts, b.ts) // 1000) AS line
  FROM a JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - {HOUR} AND a.ts + {HOUR}"""))
def joined_lines(spark, sf):
    folder = fresh_dir(spark, "lines")
    joined = interval_join(*click_view(spark, sf), "user_id", "ts", "ts", -HOUR, HOUR, select=numeric_pair("user_id"), row_id="event_id")
    sinks.write_pairs(joined, folder, key="user_id", event_us="ts")
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query("k2_append_metrics", sql(f"""SELECT 'r' || run AS run_id, parallelism, total, round(mean, 6) AS mean, p50 AS "50" FROM rec""", RECORDS))
def append_metrics(spark, sf):
    """Records of two appends land beside each other; one of them is repeated, and a third broke before it was published."""
    folder = fresh_dir(spark, "metrics")
    records = durable(_records(spark, sf).withColumn("run_id", F.concat(F.lit("r"), F.col("run").cast("string"))))
    sinks.append_metrics(records.where("run = 0"), folder)
    sinks.append_metrics(records.where("run <> 0"), folder)
    sinks.append_metrics(records.where("run <> 0"), folder)
    records.where("run = 0").write.partitionBy("run_id").json(f"{folder}/data/attempt=broken")
    return sinks.read_appended(spark, folder, records.schema).select("run_id", "parallelism", "total", F.round("mean", 6).alias("mean"), "`50`")


@query("k3_dump_latencies", sql("SELECT amount AS latency FROM ev"))
def dump_latencies(spark, sf):
    folder = fresh_dir(spark, "latencies")
    sinks.dump_latencies(events(spark, sf), folder, "amount")
    return spark.read.schema("latency double").csv(folder)


@query("k4_append_throughput", sql("SELECT 'r' || run AS run_id, parallelism, total AS throughput FROM rec", RECORDS))
def append_throughput(spark, sf):
    folder = fresh_dir(spark, "throughput")
    rates = _records(spark, sf).select(F.concat(F.lit("r"), F.col("run").cast("string")).alias("run_id"), "parallelism", (F.col("total") + F.lit(0.5)).alias("throughput"))
    sinks.append_throughput(rates, folder)
    return sinks.read_appended(spark, folder, "parallelism long, throughput long")


@query("r1_read_results", sql(f"""SELECT 32::BIGINT AS batch, 1::BIGINT AS source_degree, parallelism, parallelism AS test_index, total, round(mean, 6) AS mean,
  p0 AS "0", p5 AS "5", p95 AS "95", p100 AS "100" FROM rec""", RECORDS))
def read_results(spark, sf):
    """A tree of result folders whose files hold JSON arrays."""
    folder = fresh_dir(spark, "tree")
    record = F.struct("total", "samples", "mean", *[f"`{n}`" for n in ("0", "5", "25", "50", "75", "95", "100")])
    folders = ["batch_dir", "source_dir", "test_dir"]
    arrays = _tree(_records(spark, sf)).groupBy(*folders).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy(*folders).text(folder)
    read = results.read_metrics(spark, folder, name="*.txt")
    return read.select("batch", "source_degree", "parallelism", "test_index", "total", F.round("mean", 6).alias("mean"), "`0`", "`5`", "`95`", "`100`")
