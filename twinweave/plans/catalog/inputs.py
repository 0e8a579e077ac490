"""Reading, timing, replaying and generating inputs; scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave import model
from twinweave.functions import clock, text
from twinweave.functions.integers import trunc_div
from twinweave.operators.scan import running_total
from twinweave.operators.skew import key_frequency
from twinweave.plans.catalog.joins import ROUND_ROBIN_SQL
from twinweave.plans.catalog.registry import DRAW_1_SQL, DRAW_2_SQL, draw_1, draw_2, events, query, sql
from twinweave.plans.experiments import comparison_streams, interval_experiment, window_experiment
from twinweave.session import durable, fresh_dir
from twinweave.sources import files, generated, timeline

KEYS = 50


def offsets(spark, sf):
    """Events as rows of a dataset: place in the file, key, gap to the row before."""
    return events(spark, sf).select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("key"), F.col("value"), F.pmod(F.col("event_id") * 37, F.lit(501)).cast("long").alias("ts_off"),
        "event_id",
    )


GAP_SQL = "CASE WHEN (event_id * 37) % 501 = 0 THEN 500 ELSE (event_id * 37) % 501 END"
TIMED_SQL = f"timed AS (SELECT event_id, user_id AS key, value, CAST(SUM({GAP_SQL}) OVER (ORDER BY event_id) AS BIGINT) AS elapsed_ms FROM ev)"
BASE = model.EVENT_TIME_BASE_MS


def written(spark, sf, label, *, name="r_rows"):
    """Events written as a synthetic dataset file, and the path to it."""
    rows = offsets(spark, sf).select("row_id", (F.col("key") + 1).alias("key"), "ts_off")
    sizes = rows.agg(F.max("key").alias("keys"), F.count("*").alias("rows")).first()
    path = f"{fresh_dir(spark, label)}/{name}"
    files.write_synthetic(rows, path, sizes["keys"], sizes["rows"])
    return path


# --- scans ------------------------------------------------------------------------

@query("s1_scan_text", sql("SELECT user_id AS key, 5::BIGINT AS value, (event_id * 37) % 501 AS ts_off FROM ev"))
def scan_text(spark, sf):
    return files.read_synthetic(spark, written(spark, sf, "scan"), value=model.CONSTANT_VALUE).drop("row_id")


@query("s2_header", sql("""SELECT max(user_id) + 1 AS num_keys, count(*) AS size_a, sum(CASE WHEN event_type = 'view' OR user_id = (SELECT max(user_id) FROM ev) THEN 1 ELSE 0 END)::BIGINT
  AS size_b FROM ev"""))
def header(spark, sf):
    """The headers of two inputs of different size: all events, and the views with all events of the last user."""
    path = written(spark, sf, "header")
    last = events(spark, sf).agg(F.max("user_id")).first()[0]
    some = offsets(spark, sf).join(events(spark, sf).where((F.col("event_type") == "view") | (F.col("user_id") == last)).select("event_id"), "event_id", "left_semi")
    files.write_synthetic(some.select("row_id", (F.col("key") + 1).alias("key"), "ts_off"), text.partner_path(path), last + 1, some.count())
    return files.check_same_keys(files.read_header(spark, path), files.read_header(spark, text.partner_path(path)))


@query("s3_scan_rovio", sql("SELECT user_id AS key, value, 0::BIGINT AS ts_off FROM ev"))
def scan_rovio(spark, sf):
    path = f"{fresh_dir(spark, 'rovio')}/rows"
    rows = offsets(spark, sf).withColumn("zero", F.lit(0)).withColumn("last", F.lit(1))
    files.write_lines(rows, path, ["key", "zero", "value", "last"])
    return files.read_rovio(spark, path).drop("row_id")


@query("s4_scan_stock", sql("SELECT user_id AS key, value, 0::BIGINT AS ts_off FROM ev"))
def scan_stock(spark, sf):
    path = f"{fresh_dir(spark, 'stock')}/rows"
    files.write_lines(offsets(spark, sf), path, ["key", "value"])
    return files.read_stock(spark, path).drop("row_id")


@query("s5_normalise", sql("""SELECT event_id, user_id - 1 AS key, 5::BIGINT AS constant, value AS kept, 1 + (event_id * 7919) % 100 AS drawn,
  true AS hash_in_range FROM ev"""))
def normalised(spark, sf):
    rows = offsets(spark, sf)
    rows = files.normalise(rows, key_base=1).withColumn("kept", F.col("value"))
    rows = files.normalise(rows, value="hash", seed=7).withColumnRenamed("value", "hashed")
    rows = files.normalise(rows, value=F.lit(1) + F.pmod(F.col("event_id") * 7919, F.lit(100))).withColumnRenamed("value", "drawn")
    rows = files.normalise(rows, value=model.CONSTANT_VALUE).withColumnRenamed("value", "constant")
    return rows.select("event_id", "key", "constant", "kept", "drawn", F.col("hashed").between(1, 100).alias("hash_in_range"))


@query("s6_paired_inputs", sql("""SELECT 'a' AS side, user_id AS key, (event_id * 37) % 501 AS ts_off FROM ev
  UNION ALL SELECT 'b' AS side, value AS key, (event_id * 37) % 501 AS ts_off FROM ev"""))
def paired_inputs(spark, sf):
    path = written(spark, sf, "pair")
    other = offsets(spark, sf).select("row_id", (F.col("value") + 1).alias("key"), "ts_off")
    sizes = other.agg(F.max("key").alias("keys"), F.count("*").alias("rows")).first()
    files.write_synthetic(other, text.partner_path(path), sizes["keys"], sizes["rows"])
    a, b = files.read_pair(files.read_synthetic, spark, path)
    return a.select(F.lit("a").alias("side"), "key", "ts_off").unionByName(b.select(F.lit("b").alias("side"), "key", "ts_off"))


# --- event time -------------------------------------------------------------------

@query("s7_event_time", sql(f"SELECT event_id, key, ({BASE} + elapsed_ms) * 1000 AS event_us FROM timed", TIMED_SQL))
def event_time(spark, sf):
    return timeline.with_event_time(offsets(spark, sf)).select("event_id", "key", "event_us")


@query("s7_event_time_from_file", sql("SELECT key, elapsed_ms * 1000 AS event_us FROM timed", TIMED_SQL))
def event_time_from_file(spark, sf):
    """Time of rows whose order is their order in the files; windows start at 0."""
    rows = files.read_synthetic(spark, written(spark, sf, "timed"))
    return timeline.with_event_time(rows, base_ms=0).select("key", "event_us")


@query("s8_replay", sql(f"""SELECT event_id, k AS pass, ({BASE} + elapsed_ms + k * (SELECT max(elapsed_ms) FROM timed)) * 1000 AS event_us
  FROM timed, range(3) r(k)""", TIMED_SQL))
def replayed(spark, sf):
    return timeline.replay(offsets(spark, sf), 3).select("event_id", "pass", "event_us")


@query("s9_replicas", sql(f"SELECT event_id, k AS replica, ({BASE} + elapsed_ms) * 1000 AS event_us FROM timed, range(3) r(k)", TIMED_SQL))
def replicas(spark, sf):
    return timeline.replicate(timeline.with_event_time(offsets(spark, sf)), 3).select("event_id", "replica", "event_us")


@query("s10_bounded_run", sql("""SELECT event_id, emit_us FROM (
  SELECT event_id, CAST(floor(event_id * (1e6 / ((SELECT count(*) FROM ev) / 80.0e0))) AS BIGINT) AS emit_us FROM ev) WHERE emit_us <= 60000000"""))
def bounded_run(spark, sf):
    """60 seconds of a source that would need 80 seconds for the whole table."""
    rows = offsets(spark, sf)
    return timeline.bounded_run(timeline.paced(rows, rows.count() / 80), 60).select("event_id", "emit_us")


@query("s11_paced_source", sql("SELECT event_id, CAST(floor(event_id * (1e6 / 300)) AS BIGINT) AS emit_us FROM ev"))
def paced_source(spark, sf):
    return timeline.paced(offsets(spark, sf), 300).select("event_id", "emit_us")


@query("s12_random_source", sql(f"""SELECT event_id AS row_id, 1 + CAST(floor({DRAW_1_SQL} * {KEYS}) AS BIGINT) AS key, 5::BIGINT AS value,
  ({BASE} + CAST(COALESCE(SUM(CAST(floor({DRAW_2_SQL} * 500) AS BIGINT)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
  * 1000 AS event_us FROM ev"""))
def random_source(spark, sf):
    return generated.random_source(events(spark, sf), KEYS, row_id="event_id", key_draw=draw_1(), gap_draw=draw_2())


@query("s13_round_robin", ROUND_ROBIN_SQL + "\n  SELECT 'a' AS side, * FROM sa UNION ALL SELECT 'b' AS side, * FROM sb")
def round_robin(spark, sf):
    a, b = comparison_streams(events(spark, sf).select(F.col("event_id").alias("row_id")), num_keys=10)
    return a.drop("event_us").withColumn("side", F.lit("a")).unionByName(b.drop("event_us").withColumn("side", F.lit("b")))


@query("s14_shifted", sql("SELECT event_id, (ts // 1000 + 125) * 1000 AS event_us FROM ev"))
def shifted(spark, sf):
    return timeline.shifted(events(spark, sf).withColumn("ts", trunc_div(F.col("ts"), 1000))).select("event_id", "event_us")


def _timed_file(spark, sf, base_ms):
    """A dataset file with event times, written once: the joins below read it several times."""
    read = files.read_synthetic(spark, written(spark, sf, "experiment"), value=model.CONSTANT_VALUE)
    return durable(timeline.with_event_time(read, base_ms=base_ms, out="ts"))


@query("file_interval_experiment", sql(f"""
  SELECT x.key, 10::BIGINT AS value, GREATEST(x.elapsed_ms, y.elapsed_ms) * 1000 + {BASE * 1000} AS ts
  FROM timed x JOIN timed y ON x.key = y.key AND y.elapsed_ms BETWEEN x.elapsed_ms - 30000 AND x.elapsed_ms + 30000""", TIMED_SQL))
def file_interval_experiment(spark, sf):
    """From a dataset file to joined rows: +-30 s, the widest interval of the benchmark series."""
    rows = _timed_file(spark, sf, BASE)
    return interval_experiment(rows, rows, -30000, 30000)


@query("file_window_experiment", sql("""
  SELECT x.key, 10::BIGINT AS value, GREATEST(x.elapsed_ms, y.elapsed_ms) * 1000 AS ts, x.elapsed_ms // 20000 * 20000000 AS w_start
  FROM timed x JOIN timed y ON x.key = y.key AND x.elapsed_ms // 20000 = y.elapsed_ms // 20000""", TIMED_SQL))
def file_window_experiment(spark, sf):
    """The same with tumbling windows of 20 s, which start at time 0, and split hot keys."""
    rows = _timed_file(spark, sf, 0)
    return window_experiment(rows, rows, 20000, strategy="hybrid")


# --- generators -------------------------------------------------------------------

@query("g1_uniform_keys", sql(f"SELECT event_id AS row_id, 1 + CAST(floor({DRAW_1_SQL} * {KEYS}) AS BIGINT) AS key FROM ev"))
def uniform_keys(spark, sf):
    return generated.dataset_rows(events(spark, sf), "uniform", KEYS, row_id="event_id", key_draw=draw_1()).drop("ts_off")


ZIPF_SQL = f"""z AS (SELECT SUM(pow(1.0e0 / i, 0.8e0)) AS zn, 1 + pow(0.5e0, 0.8e0) AS z2 FROM range(1, {KEYS + 1}) r(i)),
  d AS (SELECT event_id, {DRAW_1_SQL} AS u, zn, z2, (1 - pow(2.0e0 / {KEYS}, 1 - 0.8e0)) / (1 - z2 / zn) AS eta FROM ev, z)"""


@query("g2_zipf_keys", sql(f"""SELECT event_id AS row_id, CASE WHEN u * zn < 1 THEN 1 WHEN u * zn < z2 THEN 2
  ELSE 1 + CAST(trunc({KEYS} * pow(eta * u - eta + 1, 1 / (1 - 0.8e0))) AS BIGINT) END AS key FROM d""", ZIPF_SQL))
def zipf_keys(spark, sf):
    return generated.dataset_rows(events(spark, sf), "zipf", KEYS, row_id="event_id", key_draw=draw_1()).drop("ts_off")


@query("g3_selfsimilar_keys", sql(f"""SELECT event_id AS row_id, 1 + CAST(trunc({KEYS} * pow({DRAW_1_SQL}, ln(0.35e0) / ln(1 - 0.35e0))) AS BIGINT) AS key FROM ev"""))
def selfsimilar_keys(spark, sf):
    return generated.dataset_rows(events(spark, sf), "selfsimilar", KEYS, skew=0.35, row_id="event_id", key_draw=draw_1()).drop("ts_off")


@query("g4_time_offsets", sql(f"SELECT event_id AS row_id, CAST(floor({DRAW_2_SQL} * 501) AS BIGINT) AS ts_off FROM ev"))
def time_offsets(spark, sf):
    return generated.dataset_rows(events(spark, sf), "uniform", KEYS, row_id="event_id", offset_draw=draw_2()).drop("key")


G5_SQL = f"""z AS (SELECT SUM(pow(1.0e0 / i, 0.8e0)) AS zn, 1 + pow(0.5e0, 0.8e0) AS z2 FROM range(1, {KEYS + 1}) r(i)),
  d AS (SELECT side, event_id, CASE side WHEN 'a' THEN {DRAW_1_SQL} ELSE {DRAW_2_SQL} END AS u, CASE side WHEN 'a' THEN {DRAW_2_SQL} ELSE {DRAW_1_SQL} END AS o, zn, z2,
    (1 - pow(2.0e0 / {KEYS}, 1 - 0.8e0)) / (1 - z2 / zn) AS eta FROM ev, z, (VALUES ('a'), ('b')) s(side))"""


@query("g5_written_dataset", sql(f"""SELECT side, row_number() OVER (PARTITION BY side ORDER BY event_id) AS row_id, CASE WHEN u * zn < 1 THEN 1 WHEN u * zn < z2 THEN 2
  ELSE 1 + CAST(trunc({KEYS} * pow(eta * u - eta + 1, 1 / (1 - 0.8e0))) AS BIGINT) END AS key, CAST(floor(o * 501) AS BIGINT) AS ts_off,
  {KEYS}::BIGINT AS num_keys, count(*) OVER (PARTITION BY side) AS declared FROM d""", G5_SQL))
def written_dataset(spark, sf):
    """Both generated inputs, a row per event, as they are read back from their files, each with what its header declares."""
    rows = events(spark, sf).select("event_id", F.col("event_id").alias("row_id"))
    draws = {"r_rows": (draw_1(), draw_2()), "l_rows": (draw_2(), draw_1())}
    path = generated.write_dataset(spark, fresh_dir(spark, "dataset"), "zipf", KEYS, size=rows.count(), rows=rows, draws=draws)

    def read(side, path):
        head = files.read_header(spark, path)
        found = files.read_synthetic(spark, path, key_base=0)
        return found.select(F.lit(side).alias("side"), "row_id", "key", "ts_off", head.select("num_keys").scalar().alias("num_keys"), head.select("size").scalar().alias("declared"))
    return read("a", path).unionByName(read("b", text.partner_path(path)))


@query("g6_distribution_check", sql("""SELECT i AS key, round(pow(i, -1.1e0) / (SELECT SUM(pow(i, -1.1e0)) FROM range(1, 11) r(i)), 9) AS pmf,
  round(SUM(pow(i, -1.1e0)) OVER (ORDER BY i) / (SELECT SUM(pow(i, -1.1e0)) FROM range(1, 11) r(i)), 9) AS cumulative,
  COALESCE(n, 0) AS n, round(COALESCE(n, 0) / (SELECT count(*) FROM ev), 9) AS prob
  FROM range(1, 11) r(i) LEFT JOIN (SELECT user_id % 10 + 1 AS key, count(*) AS n FROM ev GROUP BY 1) o ON o.key = i"""))
def distribution_check(spark, sf):
    rows = events(spark, sf).select((F.col("user_id") % 10 + 1).alias("key"))
    freq = key_frequency(rows, rows.limit(0), "key")
    found = generated.distribution_check(generated.key_pmf(spark, 10, 1.1), freq)
    return found.select("key", *[F.round(c, 9).alias(c) for c in ("pmf", "cumulative")], "n", F.round("prob", 9).alias("prob"))


@query("w1_running_total", sql("""SELECT event_id, CAST(SUM(value) OVER (ORDER BY event_id) AS BIGINT) AS total,
  CAST(SUM(value) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS user_total FROM ev"""))
def running_totals(spark, sf):
    rows = events(spark, sf)
    rows = running_total(rows, F.col("value"), "event_id", "total")
    return running_total(rows, F.col("value"), "event_id", "user_total", by=["user_id"]).select("event_id", "total", "user_total")


@query("w4_cumulative_probability", sql("""SELECT user_id AS key, n, round(n / t, 9) AS prob, round(SUM(n) OVER (ORDER BY user_id) / t, 9) AS cumulative
  FROM (SELECT user_id, count(*) AS n, (SELECT count(*) FROM ev)::DOUBLE AS t FROM ev GROUP BY user_id)"""))
def cumulative_probability(spark, sf):
    """Of the observed key probabilities of all events, in key order."""
    rows = events(spark, sf)
    freq = durable(key_frequency(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'"), "user_id").withColumnRenamed("user_id", "key"))
    found = generated.cumulative(freq, "key", "n", "prob")
    return found.select("key", "n", *[F.round(c, 9).alias(c) for c in ("prob", "cumulative")])


# --- scalar expressions -----------------------------------------------------------

@query("e1_split_fields", sql("SELECT event_id, CAST(user_id AS VARCHAR) AS key, CAST(value AS VARCHAR) AS value, 2 AS n FROM ev"))
def split_fields(spark, sf):
    line = F.concat_ws("|", F.col("user_id").cast("string"), F.col("value").cast("string"))
    rows = events(spark, sf).select("event_id", text.fields(line).alias("f"), line.alias("line")).where(~text.is_blank(F.col("line")))
    return rows.select("event_id", F.col("f")[0].alias("key"), F.col("f")[1].alias("value"), F.size("f").alias("n"))


@query("e2_text_to_number", sql("SELECT event_id, CAST(CAST(ts AS VARCHAR) AS BIGINT) AS n FROM ev"))
def text_to_number(spark, sf):
    return events(spark, sf).select("event_id", text.to_long(F.col("ts").cast("string")).alias("n"))


@query("e3_key_label", sql("SELECT event_id, 'key_' || user_id AS label FROM ev"))
def key_label(spark, sf):
    return events(spark, sf).select("event_id", text.key_label(F.col("user_id")).alias("label"))


@query("e4_key_id", sql("SELECT event_id, CASE WHEN event_type = 'view' THEN -1 ELSE user_id END AS key FROM ev"))
def key_id(spark, sf):
    label = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(text.key_label(F.col("user_id")))
    return events(spark, sf).select("event_id", text.key_id(label).alias("key"))


@query("e5_greater_and_lesser", sql("SELECT event_id, GREATEST(user_id, value) AS high, LEAST(user_id, value) AS low FROM ev"))
def greater_and_lesser(spark, sf):
    return events(spark, sf).select("event_id", F.greatest("user_id", "value").alias("high"), F.least("user_id", "value").alias("low"))


@query("e6_time_units", sql("""SELECT event_id, (event_id * 1001) / 1e3::DOUBLE AS us, event_id * 1001 // 1000 AS whole_us,
  ts / 1000::DOUBLE AS ms, ts * 1000 AS from_ms FROM ev"""))
def time_units(spark, sf):
    ns = F.col("event_id") * 1001
    return events(spark, sf).select("event_id", clock.ns_to_us(ns).alias("us"), clock.ns_to_whole_us(ns).alias("whole_us"),
                                    clock.us_to_ms(F.col("ts")).alias("ms"), clock.ms_to_us(F.col("ts")).alias("from_ms"))


@query("e7_arithmetic", sql("""SELECT event_id, round(pow(amount, 0.5e0), 6) AS root, round(ln(1 + amount), 6) AS log,
  CAST(floor(-amount) AS BIGINT) AS floor, value // 7 AS quotient, CASE WHEN value // 7 < 1 THEN 1 ELSE value // 7 END AS step FROM ev"""))
def arithmetic(spark, sf):
    quotient = trunc_div(F.col("value"), 7)
    return events(spark, sf).select(
        "event_id", F.round(F.pow("amount", F.lit(0.5)), 6).alias("root"), F.round(F.log(F.col("amount") + 1), 6).alias("log"),
        F.floor(-F.col("amount")).alias("floor"), quotient.alias("quotient"),
        F.when(quotient < 1, F.lit(1).cast("long")).otherwise(quotient).alias("step"))


@query("e8_record_hash", sql("SELECT event_id, xor(user_id, ts) AS hash FROM ev"))
def record_hash(spark, sf):
    """Key xor time; salts use ``xxhash64``, which spreads neighbouring values better."""
    return events(spark, sf).select("event_id", F.col("user_id").bitwiseXOR(F.col("ts")).alias("hash"))


@query("e9_replace_first", sql("SELECT event_id, 'l_rows_r_' || user_id AS path FROM ev"))
def replace_first(spark, sf):
    path = F.concat(F.lit("r_rows_r_"), F.col("user_id").cast("string"))
    return events(spark, sf).select("event_id", text.replace_first(path, "r_", "l_").alias("path"))


@query("e10_run_fields", sql("""SELECT event_id, user_id AS test_index, user_id % 5 AS parallelism, value AS batch, user_id % 3 AS source_degree,
  CAST(NULL AS BIGINT) AS "interval" FROM ev"""))
def run_fields(spark, sf):
    col = {c: F.col(c).cast("string") for c in ("user_id", "value")}
    path = F.concat(F.lit("results/"), col["value"], F.lit("_batch/"), (F.col("user_id") % 3).cast("string"), F.lit("_source/"),
                    col["user_id"], F.lit("_test_"), (F.col("user_id") % 5).cast("string"), F.lit("/latency.json"))
    rows = text.with_run_fields(events(spark, sf).withColumn("path", path), "path", "test_index", "parallelism", "batch", "source_degree", "interval")
    return rows.select("event_id", "test_index", "parallelism", "batch", "source_degree", "interval")
