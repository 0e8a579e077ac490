"""Dataset files, event time, generators."""

import random

import pytest
from pyspark.sql import functions as F

from twinweave import model
from twinweave.functions import draws, text
from twinweave.plans.experiments import interval_experiment, load_streams, window_experiment
from twinweave.sources import files, generated, timeline


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_synthetic_file(spark, tmp_path):
    path = write(tmp_path / "r_u.txt", "2|3\n1|120\n\n2|0\n1|500\n")
    got = files.read_synthetic(spark, path, value=5).orderBy("row_id")
    assert [r[1:] for r in rows_of(got)] == [(0, 5, 120), (1, 5, 0), (0, 5, 500)]
    assert rows_of(files.read_header(spark, path)) == [(2, 3)]
    timed = timeline.with_event_time(got).orderBy("row_id").select("event_us")
    base = model.EVENT_TIME_BASE_MS
    assert [r[0] for r in rows_of(timed)] == [(base + d) * 1000 for d in (120, 620, 1120)]


@pytest.mark.parametrize("line", ["1", "1|2|3", "x|2", "1|2.5"])
def test_bad_rows_fail(spark, tmp_path, line):
    path = write(tmp_path / "r_bad.txt", f"2|3\n1|120\n{line}\n")
    with pytest.raises(Exception, match="not a"):
        files.read_synthetic(spark, path).collect()


def test_rows_keep_file_order_over_many_splits(spark, tmp_path):
    n = 5000
    path = write(tmp_path / "r_big.txt", f"7|{n}\n" + "".join(f"{i % 7 + 1}|{i % 501}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = files.read_synthetic(spark, path, value=None).orderBy("row_id").select("key", "ts_off")
        assert got.rdd.getNumPartitions() >= 1
        assert rows_of(got) == [(i % 7, i % 501) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_dataset_is_read_back_in_order(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 9 + 1).alias("key"), (F.col("id") % 501).alias("ts_off"))
    files.write_synthetic(rows, str(tmp_path / "d" / "r_rows"), 1000, 1000, files=5)  # as many keys as rows
    read = files.read_synthetic(spark, str(tmp_path / "d" / "r_rows"), value=1).orderBy("row_id").select("key", "ts_off")
    assert rows_of(read) == [(i % 9, i % 501) for i in range(1000)]
    assert rows_of(files.read_header(spark, str(tmp_path / "d" / "r_rows"))) == [(1000, 1000)]


def test_row_ids_do_not_depend_on_the_number_of_files(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 9 + 1).alias("key"), (F.col("id") % 501).alias("ts_off"))
    for n in (1, 4):
        path = str(tmp_path / str(n) / "r_rows")
        files.write_synthetic(rows, path, 9, 300, files=n)
        got = files.read_synthetic(spark, path).orderBy("row_id").select("row_id", "key", "ts_off")
        assert rows_of(got) == [(i + 1, i % 9, i % 501) for i in range(300)]


def test_rovio_and_stock(spark, tmp_path):
    r = write(tmp_path / "rovio.txt", "7|0|15|0\n8|1|16|2\n")
    s = write(tmp_path / "stock.txt", "42|17\n")
    assert sorted(r_[1:] for r_ in rows_of(files.read_rovio(spark, r))) == [(7, 15, 0), (8, 16, 0)]
    assert [r_[1:] for r_ in rows_of(files.read_stock(spark, s))] == [(42, 17, 0)]
    assert [r_[1:] for r_ in rows_of(files.read_stock(spark, s, key_base=1, value=1))] == [(41, 1, 0)]
    with pytest.raises(Exception, match="not a rovio row"):
        files.read_rovio(spark, s).collect()


def test_pairs_and_headers(spark, tmp_path):
    assert text.partner_path("/data/r_dir/r_for_r_.txt") == "/data/r_dir/l_for_r_.txt"
    path = write(tmp_path / "r_dir" / "r_x.txt", "2|1\n1|5\n")
    write(tmp_path / "r_dir" / "l_x.txt", "2|2\n2|6\n1|7\n")
    a, b = files.read_pair(files.read_synthetic, spark, path, value=1)
    assert (a.count(), b.count()) == (1, 2)
    ha, hb = files.read_header(spark, path), files.read_header(spark, text.partner_path(path))
    assert rows_of(files.check_same_keys(ha, hb)) == [(2, 1, 2)]
    other = files.read_header(spark, write(tmp_path / "r_y.txt", "3|1\n1|5\n"))
    with pytest.raises(Exception, match="different numbers of keys"):
        files.check_same_keys(ha, other).collect()


def test_hash_values_are_stable_and_in_range(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_id"), F.lit(1).cast("long").alias("key"), F.lit(0).cast("long").alias("value"))
    one = rows_of(files.normalise(rows, value="hash", seed=1).orderBy("row_id").select("value"))
    two = rows_of(files.normalise(rows.repartition(7), value="hash", seed=1).orderBy("row_id").select("value"))
    assert one == two and {v for v, in one} == set(range(1, 101))
    assert one != rows_of(files.normalise(rows, value="hash", seed=2).orderBy("row_id").select("value"))


def test_replay_equals_a_loop(spark):
    gaps = [120, 0, 500, 3]
    df = spark.createDataFrame(list(enumerate(gaps)), "row_id long, ts_off long")
    got = rows_of(timeline.replay(df, 3, base_ms=0).orderBy("pass", "row_id").select("pass", "row_id", "event_us"))
    at, expected = 0, []
    for p in range(3):
        for i, g in enumerate(gaps):
            at += g or 500
            expected.append((p, i, at * 1000))
    assert got == expected


def test_source_copies_multiply_the_join(spark, tmp_path):
    path = write(tmp_path / "r_c.txt", "1|2\n1|100\n1|100\n")
    write(tmp_path / "l_c.txt", "1|1\n1|150\n")
    one = interval_experiment(*load_streams(spark, path), filtered=False).count()
    many = interval_experiment(*load_streams(spark, path, copies=(2, 3)), filtered=False).count()
    assert (one, many) == (2, 12)
    assert window_experiment(*load_streams(spark, path, base_ms=0), 200, filtered=False).count() == 1


def test_pace_and_run_length(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"))
    assert [r[1] for r in rows_of(timeline.paced(df, 4).orderBy("row_id"))] == [i * 250_000 for i in range(10)]
    assert timeline.bounded_run(timeline.paced(df, 4), 1).count() == 5
    assert timeline.bounded_run(timeline.paced(df, 0), 1).count() == 10
    assert timeline.passes_in_run(100, 30, 60) == 19


def test_round_robin(spark):
    got = rows_of(generated.round_robin_range(spark, 6, 3, 12).orderBy("ts"))
    assert got == [(f"key_{i % 3}", str(2 * i), 2 * i) for i in range(6)]
    assert [r[2] for r in rows_of(generated.round_robin_range(spark, 6, 3, 1).orderBy("ts"))] == list(range(6))
    with pytest.raises(Exception, match="no multiple"):
        generated.round_robin_range(spark, 7, 3, 12).collect()


def test_skewed_keys(spark, tmp_path):
    n, keys = 20_000, 50
    rows = spark.range(n).select(F.col("id").alias("row_id"))
    drawn = {d: [r[0] for r in generated.dataset_rows(rows, d, keys, skew=0.35 if d == "selfsimilar" else 0.8).select("key").collect()] for d in generated.DISTRIBUTIONS}
    for values in drawn.values():
        assert min(values) == 1 and max(values) == keys
    share = sum(k <= 17 for k in drawn["selfsimilar"]) / n       # the first 35% of the keys
    assert abs(share - 0.645) < 0.03
    zeta = sum(i ** -0.8 for i in range(1, keys + 1))
    assert abs(drawn["zipf"].count(1) / n - 1 / zeta) < 0.02
    assert abs(drawn["uniform"].count(1) / n - 1 / keys) < 0.01
    again = [r[0] for r in generated.dataset_rows(rows.repartition(3), "zipf", keys).orderBy("row_id").select("key").collect()]
    assert again == [r[0] for r in generated.dataset_rows(rows, "zipf", keys).orderBy("row_id").select("key").collect()]
    for bad in (0.0, 1.0, 1.5):
        with pytest.raises(ValueError):
            draws.zipf_int(F.lit(0.5), 1, 10, bad, 1.0)


@pytest.mark.parametrize("keys", [1, 2, 3])
def test_zipf_over_few_keys(spark, keys):
    rows = spark.range(500).select(F.col("id").alias("row_id"))
    found = {r[0] for r in generated.dataset_rows(rows, "zipf", keys).select("key").collect()}
    assert found == set(range(1, keys + 1))


def test_inputs_have_independent_seeds(spark, tmp_path):
    path = generated.write_dataset(spark, str(tmp_path / "set"), "selfsimilar", 10, size=300, skew=0.2, files=2)
    assert "dist=selfsimilar/keys=10/skew=0.2" in path
    a, b = files.read_pair(files.read_synthetic, spark, path)
    assert (a.count(), b.count()) == (300, 300)
    assert rows_of(a.orderBy("row_id").select("key")) != rows_of(b.orderBy("row_id").select("key"))


def test_pmf(spark):
    rows = generated.key_pmf(spark, 10, 1.1).orderBy("key").collect()
    assert rows[-1]["cumulative"] == pytest.approx(1.0)
    assert rows[0]["pmf"] / rows[1]["pmf"] == pytest.approx(2 ** 1.1)
    assert {r["pmf"] for r in generated.key_pmf(spark, 4).collect()} == {0.25}


def test_key_text(spark):
    df = spark.createDataFrame([("key_12",), ("xkey_7z",), ("12",), ("key_-3",)], "s string")
    assert [r[0] for r in df.select(text.key_id(F.col("s"))).collect()] == [12, 7, -1, -3]
    with pytest.raises(Exception):
        spark.createDataFrame([("key_x",)], "s string").select(text.key_id(F.col("s"))).collect()
    assert spark.range(1).select(text.replace_first(F.lit("a_r_r_"), "r_", "l_")).first()[0] == "a_l_r_"
    assert spark.range(1).select(text.replace_first(F.lit("abc"), "r_", "l_")).first()[0] == "abc"


def test_zoneless_times_in_the_hour_that_a_time_zone_skips(spark):
    from twinweave.functions.clock import ntz_micros
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.000001' AS ts")
        assert df.select(ntz_micros("ts")).first()[0] == 1710037800000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_header_of_two_equal_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 5), (1, 2, 0), (2, 3, 7)], "row_id long, key long, ts_off long")
    files.write_synthetic(rows, str(tmp_path / "s"), 3, 3, files=1)
    part = next((tmp_path / "s").glob("part-*"))
    assert part.read_text().split() == ["3|3", "1|5", "2|0", "3|7"]
    head = files.read_header(spark, str(tmp_path / "s")).first()
    assert (head["num_keys"], head["size"]) == (3, 3) and files.read_synthetic(spark, str(tmp_path / "s")).count() == 3


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    """Several files in several splits: places as in the files, and no exchange that lines pass."""
    rng = random.Random(4)
    expected, n = [], 0
    for name in ("b.txt", "a.txt", "c.txt"):
        lines = ["%s|%d" % (name[0] * rng.randrange(1, 60), k) for k in range(rng.choice([1, 900, 2500]))]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    for name in ("a.txt", "b.txt", "c.txt"):
        for k, line in enumerate((tmp_path / name).read_text().splitlines()):
            expected.append((name, k, n, line))
            n += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = files.numbered_lines(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
        got = sorted((r["path"].rsplit("/", 1)[1], r["line_no"], r["row_id"], r["line"]) for r in found.collect())
        assert found.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(expected)


def test_headers_are_read_without_the_body(spark, tmp_path):
    import gzip

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one").write_bytes(b"7|100\n" + b"\xff\xfe broken body \x00" * 1000)
    with gzip.open(tmp_path / "r" / "two.gz", "wb") as f:
        f.write(b"7|100\r\n1|2\n")
    (tmp_path / "r" / "_SUCCESS").write_text("")
    (tmp_path / "r" / "empty").write_text("")
    assert files.first_lines(spark, str(tmp_path / "r")) and [tuple(r) for r in files.read_header(spark, str(tmp_path / "r")).collect()] == [(7, 100)]
    assert [tuple(r) for r in files.read_header(spark, str(tmp_path / "r" / "one")).collect()] == [(7, 100)]
    (tmp_path / "r" / "long").write_bytes(b"9" * 10_000_000)
    assert max(map(len, files.first_lines(spark, str(tmp_path / "r")))) == files.HEADER_BYTES
