"""Streaming joins against the batch joins, over several micro-batches and with late rows."""

import random
import time
from functools import partial

import numpy as np
import duckdb
import pytest
from pyspark.sql import functions as F

from twinweave import model
from twinweave.operators.accounting import ProgressLog
from twinweave.operators.joins import interval_join, numeric_pair, window_join
from twinweave.sources import random_stream
from twinweave.sources.random_stream import RandomSource
from twinweave.sources.live import event_column, file_stream, live_random, paced_replay
from twinweave.operators import heavy
from twinweave.operators.skew import key_frequency
from twinweave.plans.catalog import QUERIES, SQL, streams
from twinweave.streaming.joins import split_table, stream_interval_join, stream_window_join
from twinweave.streaming.lateness import admit, counts
from twinweave.streaming.splits import SplitLog
from twinweave.streaming.run import live_latency_us, run_available_now, run_for, run_until_idle, sample_stream, sampled, samples

SECOND = 1_000_000
SCHEMA = "key long, value long, event_time timestamp"


def write_batches(spark, folder, batches):
    for rows in batches:
        df = spark.createDataFrame(rows, "key long, value long, ts long")
        df.select("key", "value", F.timestamp_micros("ts").alias("event_time")).coalesce(1).write.mode("append").parquet(str(folder))
    return file_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def random_batches(seed, batches=3, n=25):
    """Rows in time order, so none is late."""
    rng = random.Random(seed)
    at, out = 1_000 * SECOND, []
    for _ in range(batches):
        rows = []
        for _ in range(n):
            at += rng.randrange(1, 2 * SECOND)
            rows.append((rng.randrange(2), rng.randrange(1, 101), at))
        out.append(rows)
    return out


def as_batch(spark, batches):
    return spark.createDataFrame([r for b in batches for r in b], "key long, value long, ts long")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def pair(a, b):
    return [a["key"].alias("key"), (a.value + b.value).alias("value"), F.unix_micros(F.greatest(a.event_time, b.event_time)).alias("ts")]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    a, b = random_batches(1), random_batches(2)
    folder = tmp_path_factory.mktemp("streams")
    return a, b, write_batches(spark, folder / "a", a), write_batches(spark, folder / "b", b)


@pytest.mark.parametrize("options", [{}, {"bucketed": False}, {"salts": 3}])
def test_interval_join_equals_batch(spark, tmp_path, inputs, options):
    a, b, sa, sb = inputs
    got = run_available_now(stream_interval_join(sa, sb, "key", "event_time", "event_time", -3 * SECOND, 2 * SECOND, select=pair, **options), folder=str(tmp_path))
    expected = interval_join(as_batch(spark, a), as_batch(spark, b), "key", "ts", "ts", -3 * SECOND, 2 * SECOND, select=numeric_pair())
    assert rows_of(got) == rows_of(expected) != []


@pytest.mark.parametrize("size,slide", [(5, 5), (6, 2), (2, 5)])
def test_window_join_equals_batch(spark, tmp_path, inputs, size, slide):
    a, b, sa, sb = inputs
    got = run_available_now(stream_window_join(sa, sb, "key", "event_time", "event_time", size * SECOND, slide * SECOND, select=pair), folder=str(tmp_path))
    expected = window_join(as_batch(spark, a), as_batch(spark, b), "key", "ts", "ts", size * SECOND, slide * SECOND, select=numeric_pair())
    assert rows_of(got) == rows_of(expected) != []


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    """Three batches far apart in time: rows of the first are gone once the watermarks have passed."""
    batches = [[(1, i, (1000 * k + i) * SECOND) for i in range(20)] for k in range(1, 5)]
    sa, sb = write_batches(spark, tmp_path / "a", batches), write_batches(spark, tmp_path / "b", batches)
    joined = stream_interval_join(sa, sb, "key", "event_time", "event_time", -SECOND, SECOND, select=pair)
    log = ProgressLog(spark, str(tmp_path / "progress"), every=2)
    spark.streams.addListener(log)
    query = joined.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 140 and kept[-1] < 70  # 60 rows a batch with bucket copies, not the sum of all
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    time.sleep(2)  # the reports reach Python by a queue of their own
    spark.streams.removeListener(log)
    table = log.table().where(F.col("query") == str(query.id))
    assert table.agg(F.sum("rows")).first()[0] == 160 and table.count() > 2


def split_log(spark, folder, table):
    log = SplitLog(spark, str(folder), "key")
    like = spark.createDataFrame([], SCHEMA)
    log.start(log.from_table(table, like))
    return log


def test_split_keys_give_the_same_rows(spark, tmp_path, inputs):
    a, b, sa, sb = inputs
    freq = key_frequency(as_batch(spark, a), as_batch(spark, b), "key")
    table = split_table(freq, "key", 16, share_a=.9)
    assert any(r["splits_a"] > r["splits_b"] for r in table.collect())
    splits = split_log(spark, tmp_path / "log", table)
    got = run_available_now(stream_interval_join(sa, sb, "key", "event_time", "event_time", -3 * SECOND, 2 * SECOND, select=pair, splits=splits), folder=str(tmp_path / "i"), splits=splits)
    expected = interval_join(as_batch(spark, a), as_batch(spark, b), "key", "ts", "ts", -3 * SECOND, 2 * SECOND, select=numeric_pair())
    assert rows_of(got) == rows_of(expected) != []
    got = run_available_now(stream_window_join(sa, sb, "key", "event_time", "event_time", 5 * SECOND, select=pair, splits=splits), folder=str(tmp_path / "w"))
    expected = window_join(as_batch(spark, a), as_batch(spark, b), "key", "ts", "ts", 5 * SECOND, select=numeric_pair())
    assert rows_of(got) == rows_of(expected) != []


def test_a_restart_with_other_frequencies_loses_no_pair(spark, tmp_path):
    """Ten rows a side, stopped, ten more; the restarted query is given another table and goes on with the stored one."""
    grids = [spark.createDataFrame([(1, 3, 1)], "key long, splits_a long, splits_b long"), spark.createDataFrame([(1, 1, 3)], "key long, splits_a long, splits_b long")]
    for k, table in enumerate(grids):
        rows = [(1, 10 * k + i, (1000 + 10 * k + i) * SECOND) for i in range(10)]
        sa, sb = write_batches(spark, tmp_path / "a", [rows]), write_batches(spark, tmp_path / "b", [rows])
        log = split_log(spark, tmp_path / "log", table)
        joined = stream_interval_join(sa, sb, "key", "event_time", "event_time", -100 * SECOND, 100 * SECOND, select=lambda x, y: [x.value.alias("x"), y.value.alias("y")], splits=log)
        got = run_available_now(joined, folder=str(tmp_path / "out"), splits=log)
    assert got.count() == got.distinct().count() == 400
    assert [r["splits_a"] for r in log.table().collect()] == [3]
    with pytest.raises(RuntimeError, match="without this split log"):
        split_log(spark, tmp_path / "other", grids[1]).bind(str(tmp_path / "out" / "checkpoint"))


def test_a_key_that_turns_hot_is_spread_from_then_on(spark, tmp_path):
    """Three runs: even keys, then key 1 has most rows, then key 2. All pairs come out, and hot keys are spread over tasks one epoch later."""
    rng = random.Random(5)
    log = SplitLog(spark, str(tmp_path / "log"), "key")
    log.start([])
    arrived_a, arrived_b, at = [], [], 1000 * SECOND
    for hot in (None, 1, 2, 2):
        a, b = [], []
        for i in range(120):
            at += SECOND // 4
            for rows in (a, b):
                rows.append((hot if hot and rng.random() < .8 else rng.randrange(20), len(arrived_a) + len(a), at))
        sa, sb = write_batches(spark, tmp_path / "a", [a]), write_batches(spark, tmp_path / "b", [b])
        arrived_a, arrived_b = arrived_a + a, arrived_b + b
        joined = stream_interval_join(sa, sb, "key", "event_time", "event_time", -3 * SECOND, 2 * SECOND, select=pair, splits=log)
        got = run_available_now(joined, folder=str(tmp_path / "out"), splits=log)
        seen = [spark.createDataFrame(x, "key long, value long, ts long").withColumn("t", F.timestamp_micros("ts")) for x in (arrived_a, arrived_b)]
        begins = log.extend_from(*seen, "t", "t", 2 * SECOND, 8, since_us=at - 30 * SECOND)
        assert begins > at + 2 * SECOND
    expected = interval_join(*(x.drop("t") for x in seen), "key", "ts", "ts", -3 * SECOND, 2 * SECOND, select=numeric_pair())
    assert rows_of(got) == rows_of(expected) != []
    epochs = {}
    for r in log.table().collect():
        epochs.setdefault(r["epoch"], []).append(r["splits_a"] * r["splits_b"])
    assert 0 not in epochs and epochs[2][0] > 1 and epochs[3][0] > 1
    # rows of the last run are placed by the grid of the epoch their bucket lies in
    rows = spark.createDataFrame([(2, 0, at + 10 * SECOND), (2, 0, at - 60 * SECOND), (3, 0, at)], "key long, value long, ts long")
    cell, _ = heavy.paired_cells(rows, rows, [("key", "key")])
    placed = {(r["key"], r["ts"]): r["na"] * r["nb"] for r in log.grid(rows, cell, F.col("ts"), "n").collect()}
    assert placed[(2, at + 10 * SECOND)] > 1 and placed[(3, at)] == 1


def test_epochs_only_begin_later(spark, tmp_path):
    log = SplitLog(spark, str(tmp_path / "log"), "key")
    with pytest.raises(ValueError, match="no first epoch"):
        log.extend([], 5)
    assert log.start([(1, 2, 2)]) and not log.start([(1, 9, 9)])
    log.extend([(1, 4, 1)], 100)
    with pytest.raises(ValueError, match="after 100"):
        log.extend([], 100)
    # grids that a broken attempt left are not read
    spark.createDataFrame([(7, 5, 5)], "cell long, splits_a long, splits_b long").write.parquet(str(tmp_path / "log" / "grids" / "broken"))
    assert sorted(map(tuple, SplitLog(spark, str(tmp_path / "log"), "key").table().collect())) == [(0, 1, 2, 2), (1, 1, 4, 1)]


def test_late_rows_are_dropped(spark, tmp_path):
    a = [[(1, 1, 1000 * SECOND)], [(1, 2, 5000 * SECOND)], [(1, 3, 9000 * SECOND)], [(1, 4, 9001 * SECOND)]]
    b = [[(1, 10, 1000 * SECOND)], [(1, 20, 5000 * SECOND)], [(1, 30, 9000 * SECOND)], [(1, 40, 1001 * SECOND)]]
    sa, sb = write_batches(spark, tmp_path / "a", a), write_batches(spark, tmp_path / "b", b)
    joined = stream_interval_join(sa, sb, "key", "event_time", "event_time", -2 * SECOND, 2 * SECOND, select=pair)
    got = run_available_now(joined, folder=str(tmp_path / "out"))
    assert [r[1] for r in rows_of(got)] == [11, 22, 33, 34]
    patient = stream_interval_join(sa, sb, "key", "event_time", "event_time", -2 * SECOND, 2 * SECOND, select=pair, delay="10000 seconds")
    assert [r[1] for r in rows_of(run_available_now(patient, folder=str(tmp_path / "out2")))] == [11, 22, 33, 34, 41]


def sampled_by_loop(rows, rate, epoch):
    """The rule row by row: taken if what was taken so far is at most the rate times the time since the sampler was made."""
    count, begun, kept = {}, {}, []
    for sink, at, name in rows:
        start = begun.setdefault(sink, at if epoch is None else epoch)
        if rate == 0 or count.get(sink, 0) <= rate * (at - start) / 1e6:
            count[sink] = count.get(sink, 0) + 1
            kept.append((sink, at, name))
    return sorted(kept), {s: (begun[s], count.get(s, 0), sum(r[0] == s for r in rows)) for s in begun}


@pytest.mark.parametrize("rate,epoch", [(0.5, 0), (2.0, None), (0, None)])
def test_sampling_sink_equals_a_loop_over_batches_and_a_restart(spark, tmp_path, rate, epoch):
    rng = random.Random(8)
    at, name, rows = 1000 * SECOND, 0, []
    for k in range(5):
        part = []
        for _ in range(rng.choice([0, 40, 90])):
            at += rng.choice([0, 0, SECOND // 20, SECOND])
            part.append((rng.choice([1, 1, 1, 2, 30 + k]), at, name))
            name += 1
        rows += part
        spark.createDataFrame(part, "sink long, at long, name long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 2, 4):  # a new query each time
            stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "sink long, at long, name long").schema, files_per_batch=1)
            sample_stream(stream, str(tmp_path / "out"), sink="sink", at="at", rate=rate, epoch=epoch, order=["name"], ticks_per_second=1_000_000, available_now=True).awaitTermination()
    kept, state = sampled_by_loop(rows, rate, epoch)
    assert rows_of(samples(spark, str(tmp_path / "out"), stream.schema)) == kept != []
    assert {r["sink"]: (r["epoch"], r["taken"], r["total"]) for r in sampled(spark, str(tmp_path / "out")).collect()} == state


def test_live_source_draws_the_same_for_any_number_of_tasks(spark, tmp_path):
    """Batches of several sizes, one and eight tasks, stopped in the middle: the rows of a plain loop."""
    spark.dataSource.register(RandomSource)
    n, found = 150_000, {}
    for tasks, batch in ((1, 200_000), (8, 70_000)):
        folder = str(tmp_path / str(tasks))
        for upto in (50_001, n):
            stream = spark.readStream.format("random_events").options(numKeys=9, rows=upto, rowsPerBatch=batch, numPartitions=tasks, seed=3).load()
            rows = run_until_idle(stream, folder)
        found[tasks] = sorted(tuple(r) for r in rows.select("row_id", "key", "value", "event_us").collect())
    assert found[1] == found[8] and [r[0] for r in found[1]] == list(range(n))
    rows = np.arange(n)
    gaps, keys = random_stream.gaps_of(rows, 3), random_stream.keys_of(rows, 3, 9)
    clock = model.EVENT_TIME_BASE_MS
    for i in range(0, n, 1):
        if i < 1000 or i > n - 10 or i in (50_000, 50_001, 65_536):
            assert found[8][i] == (i, keys[i], model.CONSTANT_VALUE, clock * 1000)
        clock += int(gaps[i])
    assert set(keys.tolist()) == set(range(1, 10)) and gaps.min() == 0 and gaps.max() == 499 and abs(gaps.mean() - 249.5) < 2
    assert abs(np.corrcoef(gaps[1:], gaps[:-1])[0, 1]) < .02


def late_by_loop(rows, sources, delay):
    """Judged row by row: a row is late if it lies more than the delay before the least of the sources' greatest times so far."""
    top, kept, late = {}, [], []
    for arrival, source, at in rows:
        bound = min(top[s] for s in sources) - delay if len(top) == len(sources) else None
        (late if bound is not None and at < bound else kept).append((arrival, source, at))
        top[source] = max(top.get(source, at), at)
    return kept, late


@pytest.mark.parametrize("delay", [0, 7])
def test_lateness_row_by_row(spark, tmp_path, delay):
    rng = random.Random(delay)
    rows, at = [], 0
    for k in range(200):
        at += rng.randrange(0, 6)
        rows.append((3 * k, rng.choice("aab"), at - rng.choice([0, 0, 0, 1, 9, 30])))
    kept, late = late_by_loop(rows, "ab", delay)
    assert late and len(kept) > 50
    for part in (rows[:1], rows[1:90], [], rows[90:91], rows[91:]):  # a new query each time
        spark.createDataFrame(part, "arrival long, source string, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "arrival long, source string, at long").schema)
        admit(stream, str(tmp_path / "out"), ["a", "b"], source="source", at_us="at", arrival="arrival", delay_us=delay, block_rows=8, available_now=True).awaitTermination()
    read = lambda name: sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out" / name)).drop("batch").collect())
    assert read("admitted") == kept and read("late") == late
    assert {r["source"]: (r["admitted"], r["dropped"]) for r in counts(spark, str(tmp_path / "out")).collect()} == {
        s: (sum(r[1] == s for r in kept), sum(r[1] == s for r in late)) for s in "ab"}


def test_live_sources(spark, tmp_path):
    live = live_random(spark, 5, 200, replicas=1)
    query = live.select("key", "event_us", live_latency_us(F.col("ingest_ns")).alias("age_us")).writeStream.format("memory").queryName("live").start()
    run_for(query, 8)
    got = spark.table("live").collect()
    assert got and {r["key"] for r in got} <= set(range(1, 6))
    times = sorted(r["event_us"] for r in got)
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert all(0 <= g < 500_000 for g in gaps) and len(set(gaps)) > 100  # a clock that goes on over the batches, with gaps that are drawn anew
    assert gaps[:50] != gaps[50:100]
    assert all(r["age_us"] < 60 * SECOND for r in got)


def test_paced_replay_counts_passes(spark):
    data = spark.createDataFrame([(0, 7, 100), (1, 8, 200)], "row_id long, key long, event_us long")
    query = paced_replay(spark, data, 2, 1, 50).writeStream.format("memory").queryName("paced").start()
    run_for(query, 6)
    for r in spark.table("paced").collect():
        assert r["event_us"] == (r["row_id"] + 1) * 100 + r["pass"] * 1000


def test_zoneless_times_become_event_time(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 11:00:00' AS ts, 1 AS x")
    assert event_column(df, "ts").select(F.unix_micros("event_time")).first()[0] == 1704106800000000


def test_row_lateness_reads_a_batch_of_many_files_whole(spark, tmp_path, monkeypatch):
    """Rows of a batch lie in several files in no order: read one by one, the join's watermark would run ahead of rows that are on time."""
    monkeypatch.setattr(streams, "admit", partial(admit, block_rows=128))
    monkeypatch.setattr(streams, "fresh_dir", lambda _, label: str(tmp_path / label))
    folder = "/root/testdata/sf0.01"
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        found = QUERIES["t6_row_lateness"](spark, folder)
        got = sorted(tuple(r) for r in found.select("user_id", "a_id", "b_id", "ts").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = list((tmp_path / "lateness" / "judged" / "admitted").rglob("part-*"))
    commits = [p for p in (tmp_path / "lateness" / "out" / "checkpoint" / "commits").iterdir() if p.name.isdigit()]
    assert len(files) > 2 * streams.PARTS >= len(commits)  # a batch with rows and one without per part
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert got == sorted(con.execute(f"SELECT user_id, a_id, b_id, ts FROM ({SQL['t6_row_lateness']})").fetchall())


def test_state_is_dealt_by_the_input_and_parts_keep_apart(spark, tmp_path, monkeypatch):
    """Rows that lie mostly in one part, in several files: still a micro-batch per part, and no more state stores than the input asks for."""
    from pathlib import Path

    rows = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.when(F.col("id") < 10, F.col("id") * 100).otherwise(F.col("id") + 1_000_000) * SECOND).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sf, folders = str(tmp_path), []
    monkeypatch.setattr(streams, "FILE_BYTES", streams._bytes(spark, f"{sf}/events.parquet") // 11)  # three files for each of four parts
    monkeypatch.setattr(streams, "run_available_now", lambda df, label, **k: folders.append(str(tmp_path / label)) or run_available_now(df, folder=folders[-1], **k))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = QUERIES["t2_watermark"](spark, sf).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in Path(folders[0], "checkpoint/state/0").iterdir() if p.name.isdigit()]) == 2 * spark.sparkContext.defaultParallelism
    parts = Path(streams._parts[(spark.sparkContext.applicationId, sf)][0].removeprefix("file:"))
    assert len(list(parts.glob("part-*"))) == 3 * streams.PARTS
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    assert sorted(tuple(r) for r in found) == sorted(con.execute(SQL["t2_watermark"]).fetchall())
