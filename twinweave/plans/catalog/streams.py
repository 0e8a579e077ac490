"""Streaming queries, run to the end of their input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave import model
from twinweave.functions.clock import ntz_micros
from twinweave.operators.joins import numeric_pair
from twinweave.plans.catalog.joins import IDS_SQL, SIX_HOURS, _windows_sql
from twinweave.plans.catalog.registry import HOUR, events, query, sql, table
from twinweave.session import fresh_dir, task_slots
from twinweave.sources.live import event_column, file_stream
from twinweave.sources.random_stream import RandomSource
from twinweave.streaming.lateness import admit
from twinweave.streaming.joins import stream_interval_join, stream_window_join
from twinweave.streaming.run import run_available_now, run_until_idle, sample_latency, sample_stream, sampled, samples
from twinweave.streaming.splits import SplitLog

LATE_BEFORE = 1704067200000000 + 240 * HOUR   # rows of the first ten days can be late
LATER_FROM = 1704067200000000 + 480 * HOUR    # the last ten days come second


PARTS = 4
#: Bytes of a file of a part, written by a task; a part has as many files as its share of the table asks for.
FILE_BYTES = 8 << 20
_parts: dict[tuple[str, str], tuple[str, int]] = {}


def _bytes(spark, path):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def _count(spark, folder):
    """Files of a written table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    return len(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def _files(spark, sf):
    return max(1, -(-_bytes(spark, f"{sf}/events.parquet") // (PARTS * FILE_BYTES)))


def _state_tasks(spark, sf):
    """Over how many tasks the state of a join is dealt: two for each core, and more as the table grows, up to the shuffle partitions."""
    return min(task_slots(spark), max(2 * spark.sparkContext.defaultParallelism, PARTS * _files(spark, sf)))


def _write_parts(spark, sf, folder, wanted):
    """Append some of ``PARTS`` equal spans of time of the events, each as so many files of about one size, in any order: they are one micro-batch."""
    rows = table(spark, sf, "events")
    times = events(spark, sf).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    files = _files(spark, sf)
    for k in wanted:
        low, high = (times["a"] + (times["b"] + 1 - times["a"]) * n // PARTS for n in (k, k + 1))
        us = ntz_micros("ts")
        rows.where((us >= low) & (us < high)).repartition(files, "event_id").write.mode("append").parquet(folder)
        for _ in range(-_count(spark, folder) % files):  # a part of few rows: the next one's files are not to fill up its micro-batch
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return files


def _in_parts(spark, sf):
    """The events as ``PARTS`` parts in order of time, written once per session: state is carried from one micro-batch to the next."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _parts:
        folder = fresh_dir(spark, "parts")
        _parts[at] = folder, _write_parts(spark, sf, folder, range(PARTS))
    return _parts[at]


def _stream_of(spark, sf, folder, event_type, files):
    schema = table(spark, sf, "events").schema
    rows = event_column(file_stream(spark, folder, schema, files_per_batch=files), "ts")
    return rows.where(F.col("event_type") == event_type).select("event_id", "event_time", "user_id", F.floor("value").alias("value"))


def event_stream(spark, sf, event_type):
    """One event type of the events table as a stream with one event-time column, a part per micro-batch."""
    folder, files = _in_parts(spark, sf)
    return _stream_of(spark, sf, folder, event_type, files)


def ids(a, b):
    return [a.user_id.alias("user_id"), a.event_id.alias("a_id"), b.event_id.alias("b_id"),
            F.unix_micros(F.greatest(a.event_time, b.event_time)).alias("ts")]


@query("t1_event_time", sql("SELECT event_id, ts AS event_us FROM a"))
def event_time(spark, sf):
    rows = event_stream(spark, sf, "click").select("event_id", F.unix_micros("event_time").alias("event_us"))
    return run_available_now(rows, "event-time")


@query("t2_watermark", sql("SELECT user_id, a_start AS w_start, count(*) AS pairs FROM (SELECT a.user_id, a.ts // 3600000000 * 3600000000 AS a_start FROM a JOIN b "
                           "ON a.user_id = b.user_id AND a.ts // 3600000000 = b.ts // 3600000000) GROUP BY 1, 2"))
def watermark(spark, sf):
    """Zero lateness on both inputs; the slower input sets the watermark of the join."""
    pairs = stream_window_join(event_stream(spark, sf, "click"), event_stream(spark, sf, "view"), "user_id", "event_time", "event_time", HOUR, select=ids)
    return run_available_now(pairs, "watermark", state_tasks=_state_tasks(spark, sf)).groupBy("user_id", "w_start").agg(F.count("*").alias("pairs"))


@query("t2_closed_windows", sql("""SELECT w_start, count(*) AS n FROM (SELECT ts, ts // 3600000000 * 3600000000 AS w_start FROM a UNION ALL SELECT ts, ts // 3600000000 * 3600000000 FROM b)
  WHERE w_start + 3600000000 <= LEAST((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) // 1000 * 1000 GROUP BY w_start"""))
def closed_windows(spark, sf):
    """Only windows that the watermark of both inputs (the slower one) has passed come out."""
    both = None
    for kind in ("click", "view"):
        one = event_stream(spark, sf, kind).withWatermark("event_time", "0 seconds")
        both = one if both is None else both.unionByName(one)
    counted = both.groupBy(F.window("event_time", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run_available_now(counted.select(F.unix_micros("w.start").alias("w_start"), "n"), "closed", state_tasks=_state_tasks(spark, sf))


@query("t3_stream_interval", sql(f"SELECT {IDS_SQL} FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"))
def stream_interval(spark, sf):
    pairs = stream_interval_join(event_stream(spark, sf, "click"), event_stream(spark, sf, "view"), "user_id", "event_time", "event_time",
                                 -6 * HOUR, 6 * HOUR, select=ids)
    return run_available_now(pairs, "interval", state_tasks=_state_tasks(spark, sf))


@query("t3_stream_interval_salted", sql(f"SELECT {IDS_SQL} FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"))
def stream_interval_salted(spark, sf):
    pairs = stream_interval_join(event_stream(spark, sf, "click"), event_stream(spark, sf, "view"), "user_id", "event_time", "event_time",
                                 -6 * HOUR, 6 * HOUR, select=ids, salts=3, row_id="event_id")
    return run_available_now(pairs, "interval-salted", state_tasks=_state_tasks(spark, sf))


@query("t4_stream_tumbling", _windows_sql(6 * HOUR, 6 * HOUR))
def stream_tumbling(spark, sf):
    pairs = stream_window_join(event_stream(spark, sf, "click"), event_stream(spark, sf, "view"), "user_id", "event_time", "event_time", 6 * HOUR, select=ids)
    return run_available_now(pairs, "tumbling", state_tasks=_state_tasks(spark, sf))


WORKERS = 400  # more than a small table needs, so that some users are hot


def _user_log(spark, sf, folder):
    """Grids of the users from the table, as known before the run; kept with the query."""
    log = SplitLog(spark, f"{folder}/splits", "user_id")
    rows = table(spark, sf, "events").select("user_id", "event_type")
    log.start_from(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), WORKERS)
    return log


@query("t3_stream_interval_hybrid", sql(f"SELECT {IDS_SQL} FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"))
def stream_interval_hybrid(spark, sf):
    folder = fresh_dir(spark, "interval-hybrid")
    log = _user_log(spark, sf, folder)
    pairs = stream_interval_join(event_stream(spark, sf, "click"), event_stream(spark, sf, "view"), "user_id", "event_time", "event_time",
                                 -6 * HOUR, 6 * HOUR, select=ids, splits=log, row_id="event_id", a_row_id="event_id")
    return run_available_now(pairs, folder=folder, splits=log, state_tasks=_state_tasks(spark, sf))


@query("t3_stream_interval_epochs", sql(f"SELECT {IDS_SQL} FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"))
def stream_interval_epochs(spark, sf):
    """The query is stopped after each part; the users that were hot in it get grids for the time after it, and the query goes on."""
    folder = fresh_dir(spark, "epochs")
    schema = table(spark, sf, "events").schema
    log = SplitLog(spark, f"{folder}/splits", "user_id")
    log.start([])
    for k in range(PARTS):
        files = _write_parts(spark, sf, f"{folder}/in", [k])
        pairs = stream_interval_join(*(_stream_of(spark, sf, f"{folder}/in", t, files) for t in ("click", "view")), "user_id", "event_time", "event_time",
                                     -6 * HOUR, 6 * HOUR, select=ids, splits=log, row_id="event_id", a_row_id="event_id")
        found = run_available_now(pairs, folder=folder, splits=log, state_tasks=_state_tasks(spark, sf))
        if k + 1 < PARTS:
            arrived = spark.read.schema(schema).parquet(f"{folder}/in")
            log.extend_from(arrived.where("event_type = 'click'"), arrived.where("event_type = 'view'"), "ts", "ts", 6 * HOUR, WORKERS)
    return found


@query("t4_stream_tumbling_hybrid", _windows_sql(6 * HOUR, 6 * HOUR))
def stream_tumbling_hybrid(spark, sf):
    folder = fresh_dir(spark, "tumbling-hybrid")
    log = _user_log(spark, sf, folder)
    pairs = stream_window_join(event_stream(spark, sf, "click"), event_stream(spark, sf, "view"), "user_id", "event_time", "event_time", 6 * HOUR,
                               select=ids, splits=log, row_id="event_id", a_row_id="event_id")
    return run_available_now(pairs, folder=folder, splits=log, state_tasks=_state_tasks(spark, sf))


@query("t5_stream_sliding", _windows_sql(6 * HOUR, 2 * HOUR))
def stream_sliding(spark, sf):
    pairs = stream_window_join(event_stream(spark, sf, "click"), event_stream(spark, sf, "view"), "user_id", "event_time", "event_time", 6 * HOUR, 2 * HOUR, select=ids)
    return run_available_now(pairs, "sliding", state_tasks=_state_tasks(spark, sf))


@query("t5_stream_hopping_gap", _windows_sql(2 * HOUR, 6 * HOUR))
def stream_hopping(spark, sf):
    pairs = stream_window_join(event_stream(spark, sf, "click"), event_stream(spark, sf, "view"), "user_id", "event_time", "event_time", 2 * HOUR, 6 * HOUR, select=ids)
    return run_available_now(pairs, "hopping", state_tasks=_state_tasks(spark, sf))


@query("t6_late_data", sql(f"SELECT {IDS_SQL} FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS} WHERE NOT (b.ts < {LATE_BEFORE} AND b.value % 2 = 0)"))
def late_data(spark, sf):
    """Views of the first ten days with an even value arrive last, far behind the watermark, and are dropped."""
    folder = fresh_dir(spark, "late")
    rows = table(spark, sf, "events")
    us = events(spark, sf).select("event_id", F.col("ts").alias("us"), F.col("value").alias("whole"))
    rows = rows.join(us, "event_id")
    late = (F.col("event_type") == "view") & (F.col("us") < LATE_BEFORE) & (F.col("whole") % 2 == 0)
    arrival = F.when(late, 2).when(F.col("us") >= LATER_FROM, 1).otherwise(0)
    parts = rows.withColumn("arrival", arrival).drop("us", "whole")
    schema = parts.drop("arrival").schema

    def stream(event_type):
        read = event_column(file_stream(spark, f"{folder}/in", schema), "ts")
        return read.where(F.col("event_type") == event_type).select("event_id", "event_time", "user_id")

    for i in range(3):  # the query is stopped between arrivals and goes on from its checkpoint
        parts.where(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        pairs = stream_interval_join(stream("click"), stream("view"), "user_id", "event_time", "event_time", -6 * HOUR, 6 * HOUR, select=ids)
        found = run_available_now(pairs, folder=f"{folder}/out", state_tasks=_state_tasks(spark, sf))
    return found


@query("t7_live_latency", sql(f"SELECT 0::BIGINT AS sink_id, count(*) AS samples, true AS plausible FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"))
def live_latency(spark, sf):
    """Latency of every joined row, measured per micro-batch and stored as it arrives."""
    folder = fresh_dir(spark, "latency")

    def stamped(event_type):
        return event_stream(spark, sf, event_type).withColumn("ingest_ns", F.unix_micros(F.current_timestamp()) * 1000)

    pairs = stream_interval_join(stamped("click"), stamped("view"), "user_id", "event_time", "event_time", -6 * HOUR, 6 * HOUR,
                                 select=lambda a, b: [a.user_id.alias("user_id"), F.greatest(a.ingest_ns, b.ingest_ns).alias("ingest_ns")])
    query = sample_latency(pairs, "ingest_ns", folder, available_now=True)
    query.awaitTermination()
    samples = spark.read.schema("sink_id long, at_ns long, latency_us double").parquet(f"{folder}/samples")
    return samples.groupBy("sink_id").agg(F.count("*").alias("samples"), F.every(F.col("latency_us").between(0, 60_000_000)).alias("plausible"))


T6_SHIFT = 601
T6_SQL = f"""arrived AS (SELECT *, event_id * 2 + CASE WHEN event_type = 'view' AND value % 2 = 0 THEN {T6_SHIFT} ELSE 0 END AS arrival FROM ev WHERE event_type IN ('click', 'view')),
  marked AS (SELECT *, max(CASE WHEN event_type = 'click' THEN ts END) OVER o AS wa, max(CASE WHEN event_type = 'view' THEN ts END) OVER o AS wb FROM arrived
    WINDOW o AS (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ontime AS (SELECT * FROM marked WHERE wa IS NULL OR wb IS NULL OR ts >= LEAST(wa, wb))"""


@query("t6_row_lateness", sql(f"""SELECT {IDS_SQL} FROM (SELECT * FROM ontime WHERE event_type = 'click') a JOIN (SELECT * FROM ontime WHERE event_type = 'view') b
  ON a.user_id = b.user_id AND {SIX_HOURS}""", T6_SQL))
def row_lateness(spark, sf):
    """Views with an even value arrive some hundred rows late. Each row is judged by the watermark of the rows that arrived just before it; what is on time is joined."""
    folder = fresh_dir(spark, "lateness")
    late = (F.col("event_type") == "view") & (F.col("value") % 2 == 0)
    rows = events(spark, sf).where("event_type IN ('click', 'view')").select("event_id", "user_id", "event_type", "ts", (F.col("event_id") * 2 + F.when(late, T6_SHIFT).otherwise(0)).alias("arrival"))
    ends = rows.agg(F.min("arrival").alias("a"), F.max("arrival").alias("b")).first()
    files = _files(spark, sf)

    def stream(event_type):
        read = file_stream(spark, f"{folder}/judged/admitted", rows.schema)
        return read.where(F.col("event_type") == event_type).select("event_id", "user_id", F.timestamp_micros("ts").alias("event_time"))

    for k in range(PARTS):  # stopped after each part; all that was admitted of it, in however many files, is one micro-batch of the join
        low, high = (ends["a"] + (ends["b"] + 1 - ends["a"]) * n // PARTS for n in (k, k + 1))
        rows.where((F.col("arrival") >= low) & (F.col("arrival") < high)).repartition(files, "event_id").write.mode("append").parquet(f"{folder}/in")
        arriving = file_stream(spark, f"{folder}/in", rows.schema, files_per_batch=files)
        admit(arriving, f"{folder}/judged", ["click", "view"], source="event_type", at_us="ts", arrival="arrival", available_now=True).awaitTermination()
        pairs = stream_interval_join(stream("click"), stream("view"), "user_id", "event_time", "event_time", -6 * HOUR, 6 * HOUR, select=ids)
        found = run_available_now(pairs, folder=f"{folder}/out", state_tasks=_state_tasks(spark, sf))
    return found


@query("s12_live_source", sql("""SELECT event_id AS row_id, user_id, true AS key_in_range, true AS clock_runs, true AS drawn_once FROM ev"""))
def live_source(spark, sf):
    """As many rows of the live random source as there are events, in several micro-batches of several tasks and over a restart, beside the events."""
    spark.dataSource.register(RandomSource)
    folder = fresh_dir(spark, "random")
    rows = events(spark, sf)
    n = rows.count()
    for upto in (n // 2, n):
        stream = spark.readStream.format("random_events").options(numKeys=50, rows=upto, rowsPerBatch=max(1, n // 3), numPartitions=4).load()
        found = run_until_idle(stream, folder)
    # gaps of 0 to 499 ms after each event, from the base time on: the clock at row i lies within i times that
    elapsed = F.col("event_us") - model.EVENT_TIME_BASE_MS * 1000
    copies = found.groupBy("row_id").agg(F.count("*").alias("copies"), F.max("key").alias("key"), F.max(elapsed).alias("elapsed"))
    return rows.join(copies, F.col("event_id") == F.col("row_id")).select(
        "row_id", "user_id", F.col("key").between(1, 50).alias("key_in_range"), F.col("elapsed").between(0, F.col("row_id") * 499_000).alias("clock_runs"),
        (F.col("copies") == 1).alias("drawn_once"))


T7_RATE, T7_EPOCH = 0.00001, 1704067200000000
T7_KEPT = f"""pairs AS (SELECT a.user_id % 4 AS sink, a.event_id AS a_id, b.event_id AS b_id, GREATEST(a.ts, b.ts) AS ts FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}),
  limits AS (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY ts, a_id, b_id) AS i, count(*) OVER (PARTITION BY sink) AS total,
    CAST(floor({T7_RATE:.5f}e0 * ((ts - {T7_EPOCH}) / 1000000.0e0)) AS BIGINT) + 1 AS cap FROM pairs),
  taken AS (SELECT *, LEAST(i, i + min(cap - i) OVER (PARTITION BY sink ORDER BY i)) AS c FROM limits),
  kept AS (SELECT * FROM (SELECT *, COALESCE(lag(c) OVER (PARTITION BY sink ORDER BY i), 0) AS c0 FROM taken) WHERE c > c0)"""


@query("t7_live_sampled", sql("SELECT sink, a_id, b_id, ts, total, count(*) OVER (PARTITION BY sink) AS taken FROM kept", T7_KEPT))
def live_sampled(spark, sf):
    """Joined rows sampled in the sink at a rate of event time, over several micro-batches and a restart; all are counted."""
    folder = fresh_dir(spark, "sampled")

    def both(a, b):
        return [F.pmod(a.user_id, F.lit(4)).alias("sink"), a.event_id.alias("a_id"), b.event_id.alias("b_id"), F.unix_micros(F.greatest(a.event_time, b.event_time)).alias("ts")]

    for k in ([0, 1], [2, 3]):  # stopped in between
        files = _write_parts(spark, sf, f"{folder}/in", k)
        pairs = stream_interval_join(*(_stream_of(spark, sf, f"{folder}/in", t, files) for t in ("click", "view")), "user_id", "event_time", "event_time", -6 * HOUR, 6 * HOUR, select=both)
        sample_stream(pairs, folder, sink="sink", at="ts", rate=T7_RATE, epoch=T7_EPOCH, order=["a_id", "b_id"], ticks_per_second=1_000_000, available_now=True).awaitTermination()
    counts = sampled(spark, folder).select(F.col("sink").alias("_sink"), "total", "taken")
    kept = samples(spark, folder, pairs.schema)
    return kept.join(counts, F.col("sink") == F.col("_sink")).drop("_sink")


@query("x4_source_and_sink_functions", sql(f"""SELECT a.user_id, a.value + b.value AS value, GREATEST(a.ts, b.ts) AS ts
  FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"""))
def source_and_sink_functions(spark, sf):
    """A sink function sees every micro-batch as a DataFrame."""
    folder = fresh_dir(spark, "sink")

    def with_ts(event_type):
        return event_stream(spark, sf, event_type).withColumn("ts", F.unix_micros("event_time"))

    pairs = stream_interval_join(with_ts("click"), with_ts("view"), "user_id", "event_time", "event_time", -6 * HOUR, 6 * HOUR, select=numeric_pair("user_id"))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    running = pairs.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    running.awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{folder}/rows").select(pairs.columns)
