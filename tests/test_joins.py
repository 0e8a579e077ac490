"""Joins against brute force in Python, and all strategies against each other."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from twinweave.operators import heavy, skew
from twinweave.operators.joins import STRATEGIES, interval_join, numeric_pair, sum_below, text_pair, window_join
from twinweave.plans.catalog import QUERIES, SQL

SCHEMA = "key long, value long, ts long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(seed, n, keys, low=-2000, high=2000):
    """Rows with a hot key, nulls, exact copies and negative times."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        key = None if rng.random() < 0.05 else (0 if rng.random() < 0.4 else rng.randrange(keys))
        rows.append((key, rng.randrange(1, 101), rng.randrange(low, high)))
    return rows + rows[:3]


def pairs_interval(a, b, lower, upper, keep=lambda x, y: True):
    return sorted((x[0], x[1] + y[1], max(x[2], y[2])) for x in a for y in b
                  if x[0] is not None and x[0] == y[0] and x[2] + lower <= y[2] <= x[2] + upper and keep(x, y))


def pairs_window(a, b, size, slide):
    def starts(t):
        k = t // slide
        found = []
        while k * slide + size > t:
            found.append(k * slide)
            k -= 1
        return set(found)
    return sorted((x[0], x[1] + y[1], max(x[2], y[2]), w) for x in a for y in b
                  if x[0] is not None and x[0] == y[0] for w in starts(x[2]) & starts(y[2]))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_interval_ends_are_included(spark):
    a = frame(spark, [(1, 1, 1000)])
    b = frame(spark, [(1, 10, 499), (1, 20, 500), (1, 30, 1000), (1, 40, 1500), (1, 50, 1501), (2, 60, 1000)])
    for strategy in STRATEGIES:
        got = rows_of(interval_join(a, b, "key", "ts", "ts", -500, 500, select=numeric_pair(), strategy=strategy))
        assert got == [(1, 21, 1000), (1, 31, 1000), (1, 41, 1500)]


@pytest.mark.parametrize("lower,upper", [(-500, 500), (-300, 0), (0, 250), (100, 400), (-400, -100), (0, 0), (50, 49), (-5000, 5000)])
def test_interval_equals_brute_force(spark, lower, upper):
    a, b = random_rows(1, 60, 4), random_rows(2, 60, 4)
    expected = pairs_interval(a, b, lower, upper)
    da, db = frame(spark, a), frame(spark, b)
    for strategy in STRATEGIES:
        got = rows_of(interval_join(da, db, "key", "ts", "ts", lower, upper, select=numeric_pair(), strategy=strategy, workers=4))
        assert got == expected, strategy
    for strategy in ("hybrid", "auto"):
        got = rows_of(interval_join(da, db, "key", "ts", "ts", lower, upper, select=numeric_pair(), strategy=strategy, workers=4, split_by="key"))
        assert got == expected, strategy


@pytest.mark.parametrize("size,slide", [(500, 500), (600, 200), (500, 200), (100, 700), (1, 1), (7, 3), (3, 100), (1000, 999)])
def test_window_equals_brute_force(spark, size, slide):
    a, b = random_rows(3, 60, 3, -700, 700), random_rows(4, 60, 3, -700, 700)
    expected = pairs_window(a, b, size, slide)
    da, db = frame(spark, a), frame(spark, b)
    for strategy in STRATEGIES:
        got = rows_of(window_join(da, db, "key", "ts", "ts", size, slide, select=numeric_pair(), strategy=strategy, workers=4))
        assert got == expected, strategy


def test_tumbling_is_sliding_with_slide_equal_to_size(spark):
    a, b = frame(spark, random_rows(5, 60, 3)), frame(spark, random_rows(6, 60, 3))
    one = rows_of(window_join(a, b, "key", "ts", "ts", 400, select=numeric_pair()))
    assert one == rows_of(window_join(a, b, "key", "ts", "ts", 400, 400, select=numeric_pair()))


def test_value_filter_and_text_projection(spark):
    a, b = random_rows(7, 80, 2), random_rows(8, 80, 2)
    got = rows_of(interval_join(frame(spark, a), frame(spark, b), "key", "ts", "ts", -900, 900, select=numeric_pair(), where=sum_below(40)))
    assert got == pairs_interval(a, b, -900, 900, lambda x, y: x[1] + y[1] < 40)
    s = spark.createDataFrame([("k", "x", 1), ("k", "y", 2)], "key string, value string, ts long")
    assert rows_of(interval_join(s, s, "key", "ts", "ts", 0, 1, select=text_pair())) == [("k", "xx", 1), ("k", "xy", 2), ("k", "yy", 2)]


def test_default_columns_and_two_column_keys(spark):
    a = spark.createDataFrame([(1, "p", 10), (1, "q", 10)], "k long, c string, t long")
    b = spark.createDataFrame([(1, "p", 12)], "k long, c string, t long")
    out = interval_join(a, b, ["k", "c"], "t", "t", 0, 5)
    assert out.columns == ["a_k", "a_c", "a_t", "b_k", "b_c", "b_t"]
    assert rows_of(out) == [(1, "p", 10, 1, "p", 12)]


def test_nanosecond_times_stay_exact(spark):
    t = 1704106800000000001
    a, b = frame(spark, [(1, 1, t)]), frame(spark, [(1, 1, t + 7), (1, 2, t + 8)])
    assert rows_of(interval_join(a, b, "key", "ts", "ts", 0, 7, select=numeric_pair())) == [(1, 2, t + 7)]


def test_hot_cell_is_split_and_result_unchanged(spark):
    """A third of the rows in one key and one moment."""
    rows = [(0, i, 5) for i in range(200)] + [(1 + i % 50, i, i * 3) for i in range(400)]
    df = frame(spark, rows)
    joined = interval_join(df, df, "key", "ts", "ts", -10, 10, select=numeric_pair(), workers=16)
    assert "_salt" in joined._jdf.queryExecution().analyzed().toString()
    assert rows_of(joined) == pairs_interval(rows, rows, -10, 10)


def test_heavier_input_is_divided(spark):
    """Rows per (cell, salts) of both inputs, and how many copies there are, for a heavy first, a heavy second and two heavy inputs."""
    for n_a, n_b, most in ((4000, 4, 200), (4, 4000, 200), (900, 900, 400)):
        a, b = (frame(spark, [(1, i, 5) for i in range(n)]) for n in (n_a, n_b))
        a, b = (df.withColumn("cell", heavy.cell_hash([F.col("key")])) for df in (a, b))
        hot = heavy.hot_grid(a, b, 32, pairs=True)
        left, right = skew.spread_grid(a, b, ["cell"], [F.col("value")], [F.col("value")], hot=hot)
        for side, n in ((left, n_a), (right, n_b)):
            groups = [r["count"] for r in side.groupBy("key", "_salt_a", "_salt_b").count().collect()]
            assert max(groups) <= most
        assert left.count() + right.count() <= 8 * (n_a + n_b)
        pairs = left.select("_salt_a", "_salt_b", F.col("value").alias("x")).join(right, ["_salt_a", "_salt_b"]).select("x", "value")
        assert pairs.count() == pairs.distinct().count() == n_a * n_b


def test_heavy_cells_are_found_without_a_shuffle_of_cells(spark):
    """Names and shares against exact counts, by rows and by pairs; the plan moves sketches only."""
    rows = [(k, i, 0) for k in range(300) for i in range(1 + 4000 // (k + 1))]
    a, b = frame(spark, rows), frame(spark, [r for r in rows if r[0] % 2])
    named = [df.select(heavy.cell_hash([F.col("key")]).alias("cell")) for df in (a, b)]
    count = [{r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()} for df in named]
    for workers in (8, 64):
        for pairs in (False, True):
            load = {c: (n * count[1].get(c, 0) if pairs else n + count[1].get(c, 0)) for c, n in count[0].items()}
            total = sum(load.values())
            found = {h.cell: h for h in heavy.heavy_cells(*named, workers, pairs=pairs)}
            assert found.keys() == {c for c, n in load.items() if n > total * 1.2 / workers}
            # cells without a row in one input count there as an unnamed cell does
            assert all(h.share == pytest.approx(load[c] / total, rel=.05) and h.a == count[0][c] and abs(h.b - count[1].get(c, 0)) < 50 for c, h in found.items())
    plan = heavy.sketched(*named, 64)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 2 and not any("cell" in line for line in exchanges)
    assert heavy.heavy_cells(*(df.limit(0) for df in named), 8, pairs=True) == []


def test_sketches_find_hot_cells_among_very_many(spark):
    """More cells than a sketch keeps; one has a third of the rows."""
    ids = spark.range(300_000)
    a = ids.select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).cast("long").alias("cell"))
    b = ids.limit(30_000).select(F.xxhash64("id").alias("cell")).union(ids.limit(3000).select(F.lit(7).cast("long").alias("cell")))
    found = heavy.heavy_cells(a, b, 16, pairs=False)
    assert [h.cell for h in found] == [7] and found[0].a == pytest.approx(100_000, rel=.01)
    assert [h.cell for h in heavy.heavy_cells(a, b, 16, pairs=True)] == [7]


def test_keys_of_two_types(spark):
    """Whole numbers of other widths are one cell; what hashes could not follow is not split."""
    a = spark.createDataFrame([(1, i, 5) for i in range(60)] + [(k, 0, 9) for k in range(2, 9)], "key int, value long, ts long")
    b = a.select(F.col("key").cast("long").alias("key"), "value", "ts")
    expected = interval_join(b, b, "key", "ts", "ts", 0, 3, strategy="key").count()
    for other in (b, b.withColumn("key", F.col("key").cast("double"))):
        for strategy in ("auto", "hybrid"):
            assert interval_join(a, other, "key", "ts", "ts", 0, 3, strategy=strategy, workers=16, row_id="value", a_row_id="value").count() == expected
    floats = spark.createDataFrame([(-0.0, i, 5) for i in range(60)], "key double, value long, ts long")
    assert interval_join(floats, floats.withColumn("key", F.lit(0.0)), "key", "ts", "ts", 0, 3, workers=16, row_id="value", a_row_id="value").count() == 3600


@pytest.mark.parametrize("bad", [{"max_split": 0}, {"max_split": -2}, {"workers": 0}])
@pytest.mark.parametrize("strategy", ["data", "hybrid", "auto"])
def test_splits_must_be_positive(spark, strategy, bad):
    df = frame(spark, [(1, i, 1) for i in range(10)])
    with pytest.raises(ValueError):
        interval_join(df, df, "key", "ts", "ts", 0, 1, strategy=strategy, **bad)
    assert interval_join(df, df, "key", "ts", "ts", 0, 1, strategy=strategy, max_split=1).count() == 100


def test_even_load_is_not_salted(spark):
    df = frame(spark, [(i % 50, i, i * 1000) for i in range(400)])
    joined = interval_join(df, df, "key", "ts", "ts", -10, 10, workers=4)
    assert "_salt" not in joined._jdf.queryExecution().analyzed().toString()


def test_bad_arguments(spark):
    df = frame(spark, [(1, 1, 1)])
    with pytest.raises(ValueError):
        window_join(df, df, "key", "ts", "ts", 5, 0)
    with pytest.raises(ValueError):
        interval_join(df, df, "key", "ts", "ts", 0, 1, bucket_width=0)
    with pytest.raises(ValueError):
        interval_join(df, df, "key", "ts", "ts", 0, 1, strategy="fast")
    with pytest.raises(ValueError):
        window_join(df, df, "key", "ts", "ts", 0)
    with pytest.raises(AttributeError):
        interval_join(df, df, "key", "ts", "ts", 0, 1, select=lambda a, b: [a.nothing])


def test_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, random_rows(9, 50, 3)).withColumn("unused", F.lit("x")).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    plan = interval_join(read.where("value > 5"), read, "key", "ts", "ts", 0, 9, select=numeric_pair(), strategy="bucket")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in text
    assert "GreaterThan(value,5)" in text


@pytest.mark.parametrize("options", [{"strategy": "data", "workers": 100}, {"strategy": "bucket", "bucket_width": 2}])
def test_rows_with_many_copies_are_not_broadcast(spark, tmp_path, options):
    rows = spark.range(200).select((F.col("id") % 3).alias("key"), F.col("id").alias("ts"), F.col("id").alias("event_id"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    joined = interval_join(rows, rows, "key", "ts", "ts", -20, 20, row_id="event_id", a_row_id="event_id", **options)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == sum(abs(i - j) <= 20 and i % 3 == j % 3 for i in range(200) for j in range(200))


@pytest.mark.parametrize("crowd", [0, 30_000])
def test_data_join_reaches_ten_minutes_however_many_events_there_are(spark, tmp_path, crowd):
    """``crowd`` events of years later, an hour apart, are no partners of the first ones and take none of their pairs away."""
    rng, reach = random.Random(5), 600_000_000
    few = [(k, rng.randrange(20 * reach), rng.randrange(7)) for k in range(80)] + [(80, 0, 1), (81, reach, 6), (82, reach + 1, 1), (82, 0, 1), (83, 7, None), (83, 7, None)]
    rows = spark.createDataFrame(few, "event_id long, us long, user_id long").unionAll(
        spark.range(crowd).selectExpr("1000 + id AS event_id", "(100000 + id) * 3600000000 AS us", "id AS user_id"))
    rows.selectExpr("event_id", "CAST(timestamp_micros(us) AS TIMESTAMP_NTZ) AS ts", "user_id", "'click' AS event_type", "1.5D AS value").write.parquet(str(tmp_path / "events.parquet"))
    pairs = "key, a_id, b_id"
    got = rows_of(QUERIES["j8_interval_data"](spark, str(tmp_path)).where("a_id < 1000").select(*pairs.split(", ")))
    assert got == sorted((u % 5, i, j) for i, t, u in few for j, s, v in few if None not in (u, v) and u % 5 == v % 5 and abs(t - s) <= reach)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT {pairs} FROM ({SQL['j8_interval_data']}) WHERE a_id < 1000").fetchall())
