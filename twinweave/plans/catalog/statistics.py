"""Key statistics, loads, sampling, percentiles, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.operators import accounting, skew
from twinweave.operators.quantiles import percentiles
from twinweave.operators.sampling import rate_sample
from twinweave.operators.joins import interval_join, numeric_pair
from twinweave.plans.catalog.registry import HOUR, click_view, events, query, skewed_keys, sql
from twinweave.session import fresh_dir
from twinweave.sinks import pair_line

WORKERS, THRESHOLD, MAX_SPLIT, NUM_KEYS = 8, 1.2, 4, 25


def _frequency(spark, sf):
    rows = skewed_keys(spark, sf)
    return skew.key_frequency(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'"), "key", NUM_KEYS)


FREQ = f"""freq AS (SELECT i AS key, COALESCE(n, 0) AS n, COALESCE(n, 0) / (SELECT count(*) FROM skewed) AS prob
    FROM range({NUM_KEYS}) r(i) LEFT JOIN (SELECT key, count(*) AS n FROM skewed GROUP BY key) c ON c.key = i)"""
SPLITS = f"""splits AS (SELECT key, n, prob, LEAST({MAX_SPLIT}, GREATEST(1, CAST(ceil(prob * (8 / 1.2e0)) AS BIGINT))) AS splits FROM freq)"""
PLACED = f"""placed AS (SELECT key, part, (key + part) % {WORKERS} AS worker, prob / splits AS load FROM splits, range({MAX_SPLIT}) r(part) WHERE part < splits)"""
LOADS = f"""loads AS (SELECT w AS worker, COALESCE(SUM(load), 0) AS load FROM range({WORKERS}) r(w) LEFT JOIN placed ON worker = w GROUP BY w)"""


def _splits(spark, sf):
    return skew.with_splits(_frequency(spark, sf), WORKERS, THRESHOLD, MAX_SPLIT)


def _placed(spark, sf):
    return skew.placement(_splits(spark, sf), "key", WORKERS)


@query("a2_key_frequency", sql("SELECT key, n, round(prob, 9) AS prob FROM freq", FREQ))
def key_frequency(spark, sf):
    return _frequency(spark, sf).withColumn("prob", F.round("prob", 9))


@query("a2_user_frequency", sql("SELECT user_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM ev WHERE event_type IN ('click', 'view')), 9) AS prob "
                               "FROM ev WHERE event_type IN ('click', 'view') GROUP BY user_id"))
def user_frequency(spark, sf):
    """Without a declared number of keys only keys that occur are counted."""
    return skew.key_frequency(*click_view(spark, sf), "user_id").withColumn("prob", F.round("prob", 9))


@query("a3_load_balance", sql("SELECT round(max(load) / avg(load), 9) AS balance, min(load) > 0 AS all_loaded FROM loads", FREQ, SPLITS, PLACED, LOADS))
def load_balance(spark, sf):
    return skew.load_balance(skew.worker_load(_placed(spark, sf), WORKERS)).withColumn("balance", F.round("balance", 9))


@query("a3_measured_load", sql(f"""SELECT w AS worker, CAST(count(key) AS DOUBLE) AS load FROM range({WORKERS}) r(w)
  LEFT JOIN (SELECT s.key, (s.key + event_id % splits) % {WORKERS} AS worker FROM skewed s JOIN splits USING (key)) x ON worker = w GROUP BY w""", FREQ, SPLITS))
def measured_load(spark, sf):
    return skew.measured_load(skewed_keys(spark, sf), _splits(spark, sf), "key", F.col("event_id"), WORKERS)


@query("a4_split_summary", sql(f"SELECT avg(splits) AS avg_splits, max(splits) AS max_splits, bool_and(splits >= {MAX_SPLIT}) AS all_max_split FROM splits", FREQ, SPLITS))
def split_summary(spark, sf):
    return skew.split_summary(_splits(spark, sf), MAX_SPLIT)


@query("a5_worker_keys", sql("SELECT DISTINCT l.worker, round(l.load, 9) AS load, p.key FROM loads l LEFT JOIN placed p USING (worker)", FREQ, SPLITS, PLACED, LOADS))
def worker_keys(spark, sf):
    return skew.worker_keys(_placed(spark, sf), "key", WORKERS).withColumn("load", F.round("load", 9))


@query("o1_keys_by_probability", sql("SELECT key, n, round(prob, 9) AS prob FROM freq ORDER BY n DESC, key", FREQ))
def keys_by_probability(spark, sf):
    return skew.by_probability(_frequency(spark, sf), "key").withColumn("prob", F.round("prob", 9))


@query("o2_least_loaded_worker", sql("""SELECT worker, round(load, 9) AS load, (SELECT key FROM freq ORDER BY n DESC, key LIMIT 1) AS heaviest
  FROM loads ORDER BY round(load, 9), worker LIMIT 1""", FREQ, SPLITS, PLACED, LOADS))
def least_loaded_worker(spark, sf):
    loads = skew.worker_load(_placed(spark, sf), WORKERS).withColumn("load", F.round("load", 9))
    heaviest = skew.heaviest(_frequency(spark, sf), "key").select("key").scalar()
    return skew.least_loaded(loads).withColumn("heaviest", heaviest)


@query("u1_union", sql("SELECT event_id, user_id, event_type FROM a UNION ALL SELECT event_id, user_id, event_type FROM b"))
def union(spark, sf):
    return skew.bag_union(*click_view(spark, sf)).select("event_id", "user_id", "event_type")


# --- sampling ---------------------------------------------------------------------

EPOCH_US = 1704067200000000  # start of the events table
SAMPLE_RATE = 0.0005         # per second of event time: about half of the rows at the smallest scale


def _sinks(spark, sf):
    return events(spark, sf).select("event_id", "ts", F.pmod("user_id", F.lit(4)).cast("long").alias("sink"), "amount")


def _sample(spark, sf):
    return rate_sample(_sinks(spark, sf), sink="sink", at="ts", rate=SAMPLE_RATE, epoch=EPOCH_US, order=["event_id"], ticks_per_second=1_000_000)


# The rule row by row: taken = least(i, i + min over j <= i of (limit_j - j)), a row is kept where it grows.
KEPT = f"""limits AS (SELECT event_id, ts, user_id % 4 AS sink, amount, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS i,
    CAST(floor({SAMPLE_RATE}e0 * ((ts - {EPOCH_US}) / 1000000.0e0)) AS BIGINT) + 1 AS cap FROM ev),
  taken AS (SELECT *, LEAST(i, i + min(cap - i) OVER (PARTITION BY sink ORDER BY i)) AS c FROM limits),
  kept AS (SELECT * FROM (SELECT *, COALESCE(lag(c) OVER (PARTITION BY sink ORDER BY i), 0) AS c0 FROM taken) WHERE c > c0)"""


@query("w2_sampler", sql("SELECT event_id, sink, ts, amount FROM kept", KEPT))
def sampler(spark, sf):
    return _sample(spark, sf)


@query("w3_sampler_keep_all", sql("SELECT 'zero' AS mode, event_id FROM ev UNION ALL SELECT 'minus one' AS mode, event_id FROM ev"))
def sampler_keep_all(spark, sf):
    def kept(rate, mode):
        rows = rate_sample(_sinks(spark, sf), sink="sink", at="ts", rate=rate, epoch=EPOCH_US, order=["event_id"])
        return rows.select(F.lit(mode).alias("mode"), "event_id")
    return kept(0, "zero").unionByName(kept(-1, "minus one"))


# --- percentiles and summaries ------------------------------------------------------

PROBS_SQL = "(VALUES (0.05e0), (0.25e0), (0.5e0), (0.75e0), (0.95e0)) p(prob)"
SORTED = """srt AS (SELECT user_id % 4 AS sink, amount AS v, row_number() OVER (PARTITION BY user_id % 4 ORDER BY amount) - 1 AS k FROM ev),
  cnt AS (SELECT sink, count(*) AS n FROM srt GROUP BY sink)"""
TRUNCATED = SORTED + f""",
  trn AS (SELECT c.sink, prob, v FROM cnt c, {PROBS_SQL} JOIN srt s ON s.sink = c.sink AND s.k = CAST(floor(n * prob) AS BIGINT))"""
INTERPOLATED = SORTED + f""",
  pos AS (SELECT sink, n, prob, prob * 100 * (n + 1) / 100 AS pos FROM cnt, {PROBS_SQL}),
  itp AS (SELECT p.sink, prob, CASE WHEN pos < 1 OR pos >= n THEN lo.v ELSE lo.v + (pos - floor(pos)) * (hi.v - lo.v) END AS v FROM pos p
    JOIN srt lo ON lo.sink = p.sink AND lo.k = CASE WHEN pos < 1 THEN 0 WHEN pos >= n THEN n - 1 ELSE CAST(floor(pos) AS BIGINT) - 1 END
    JOIN srt hi ON hi.sink = p.sink AND hi.k = CASE WHEN pos < 1 THEN 0 WHEN pos >= n THEN n - 1 ELSE CAST(floor(pos) AS BIGINT) END)"""


@query("a8_percentile_trunc", sql("SELECT sink, prob, v AS value FROM trn", TRUNCATED))
def percentile_truncated(spark, sf):
    return percentiles(_sinks(spark, sf), "amount", by=["sink"])


@query("a9_percentile_interp", sql("SELECT sink, prob, round(v, 6) AS value FROM itp", INTERPOLATED))
def percentile_interpolated(spark, sf):
    return percentiles(_sinks(spark, sf), "amount", by=["sink"], method="interpolated").withColumn("value", F.round("value", 6))


def _summary_sql(ranks: str, name: str) -> str:
    columns = ", ".join(f'round(max(CASE WHEN prob = {p}e0 THEN v END), 6) AS "{n}"' for p, n in ((0.05, 5), (0.25, 25), (0.5, 50), (0.75, 75), (0.95, 95)))
    return sql(f"""SELECT s.*, {", ".join(f'"{n}"' for n in (5, 25, 50, 75, 95))} FROM
      (SELECT user_id % 4 AS sink, count(*) AS total, count(*) AS samples, round(avg(amount), 6) AS mean, min(amount) AS "0", max(amount) AS "100" FROM ev GROUP BY 1) s
      JOIN (SELECT sink, {columns} FROM {name} GROUP BY sink) r ON r.sink = s.sink""", ranks)


def _rounded(summary):
    return summary.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in ("mean", "0", "5", "25", "50", "75", "95", "100")})


@query("a7_latency_summary", _summary_sql(TRUNCATED, "trn"))
def latency_summary(spark, sf):
    return _rounded(accounting.latency_summary(_sinks(spark, sf), "amount", ["sink"]))


@query("a7_latency_summary_interp", _summary_sql(INTERPOLATED, "itp"))
def latency_summary_interpolated(spark, sf):
    return _rounded(accounting.latency_summary(_sinks(spark, sf), "amount", ["sink"], method="interpolated"))


@query("a10_merged_samples", sql("""SELECT 'latency' AS metric, (SELECT count(*) FROM ev) AS total, count(*) AS samples, round(avg(amount), 6) AS mean,
  min(amount) AS "0", max(CASE WHEN k = CAST(floor(n * 0.05e0) AS BIGINT) THEN amount END) AS "5", max(CASE WHEN k = CAST(floor(n * 0.25e0) AS BIGINT) THEN amount END) AS "25",
  max(CASE WHEN k = CAST(floor(n * 0.5e0) AS BIGINT) THEN amount END) AS "50", max(CASE WHEN k = CAST(floor(n * 0.75e0) AS BIGINT) THEN amount END) AS "75",
  max(CASE WHEN k = CAST(floor(n * 0.95e0) AS BIGINT) THEN amount END) AS "95", max(amount) AS "100"
  FROM (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS k, count(*) OVER () AS n FROM kept)""", KEPT))
def merged_samples(spark, sf):
    """Every sink samples on its own; their samples and totals then count as one metric."""
    totals = _sinks(spark, sf).groupBy("sink").agg(F.count("*").alias("total")).withColumn("metric", F.lit("latency"))
    samples = _sample(spark, sf).withColumn("metric", F.lit("latency"))
    return _rounded(accounting.latency_summary(samples, "amount", ["metric"], totals=accounting.merge_totals(totals, ["metric"])))


# --- rates ------------------------------------------------------------------------

@query("a1_operator_stats", sql("""SELECT event_type, user_id % 4 AS replica, count(*) AS rows, count(*) * 24 AS bytes, max(ts) - min(ts) AS elapsed_us,
  round(count(*) / ((max(ts) - min(ts)) / 1e6::DOUBLE), 9) AS rate, CAST(floor(count(*) / ((max(ts) - min(ts)) / 1e6::DOUBLE)) AS BIGINT) AS whole_rate
  FROM ev GROUP BY 1, 2"""))
def operator_stats(spark, sf):
    rows = events(spark, sf).withColumn("replica", F.col("user_id") % 4)
    stats = accounting.operator_stats(rows, ["event_type", "replica"], "ts")
    return stats.withColumns({"rate": F.round("rate", 9), "whole_rate": F.floor("rate")})


@query("a1_run_counters", sql("""SELECT 'clicks' AS operator, count(*) AS rows, count(*) * 24 AS bytes, min(ts) AS first_us, max(ts) AS last_us FROM a
  UNION ALL SELECT 'views', count(*), count(*) * 24, min(ts), max(ts) FROM b
  UNION ALL SELECT 'join', count(*), count(*) * 32, min(ts), max(ts) FROM joined
  UNION ALL SELECT 'sink', count(*), sum(strlen(line))::BIGINT, 0, 0 FROM lines""",
  "joined AS (SELECT a.user_id, a.value + b.value AS value, GREATEST(a.ts, b.ts) AS ts FROM a JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - 3600000000 AND a.ts + 3600000000)",
  "lines AS (SELECT user_id || chr(9) || value || chr(9) || (ts // 1000) AS line FROM joined WHERE value % 2 = 0)"))
def run_counters(spark, sf):
    """What both sources, the join and the sink of one run have handed on, counted by that run itself."""
    counters = accounting.RunCounters(spark)
    clicks, views = click_view(spark, sf)
    joined = interval_join(counters.watch(clicks, "clicks", at_us="ts"), counters.watch(views, "views", at_us="ts"), "user_id", "ts", "ts", -HOUR, HOUR,
                           select=numeric_pair("user_id"), strategy="bucket")
    joined = counters.watch(joined, "join", at_us="ts", row_bytes=32)
    lines = joined.where(F.col("value") % 2 == 0).select(pair_line("user_id", event_us="ts").alias("line"))
    counters.watch(lines, "sink", row_bytes=F.octet_length("line").cast("long")).write.text(fresh_dir(spark, "counted"))
    return counters.table()


@query("a6_throughput", sql("""SELECT sum(n)::BIGINT AS rows, round(sum(n) / (max(el) / 1e6::DOUBLE), 9) AS rows_per_s,
  round(sum(n) * 24 / (max(el) / 1e6::DOUBLE) / 1048576.0e0, 12) AS mb_per_s
  FROM (SELECT count(*) AS n, max(ts) - min(ts) AS el FROM ev GROUP BY event_type)"""))
def throughput(spark, sf):
    stats = accounting.operator_stats(events(spark, sf), ["event_type"], "ts")
    return accounting.throughput(stats).withColumns({"rows_per_s": F.round("rows_per_s", 9), "mb_per_s": F.round("mb_per_s", 12)})
