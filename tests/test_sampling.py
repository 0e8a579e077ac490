"""Sampler and percentiles against literal loops."""

import math
import random

import pytest

from twinweave.operators.accounting import latency_summary, merge_totals
from twinweave.model import PERCENTILES
from twinweave.operators import quantiles
from twinweave.operators.quantiles import percentiles
from twinweave.operators.sampling import rate_sample
from twinweave.operators.scan import running_total
from pyspark.sql import functions as F


def loop_sample(rows, rate, epoch):
    taken, out = {}, []
    for sink, at, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        c = taken.get(sink, 0)
        if c <= rate * ((at - epoch) / 1e9):
            out.append((sink, at, i))
            taken[sink] = c + 1
    return sorted(out)


@pytest.mark.parametrize("seed,rate,burst", [(0, 10, False), (1, 250, False), (2, 0.5, False), (3, 40, True), (4, 100000, True)])
def test_sampler_equals_loop(spark, seed, rate, burst):
    rng = random.Random(seed)
    rows, i = [], 0
    for sink in range(3):
        at = 1_000_000
        for _ in range(300):
            at += rng.choice([0, 0, 1_000_000, 30_000_000, 700_000_000]) if not burst else rng.choice([0, 0, 0, 0, 0, 90_000_000])
            rows.append((sink, at, i))
            i += 1
    rows += [(0, -5, i), (0, 999, i + 1)]  # before and just after the start
    df = spark.createDataFrame(rows, "sink long, at long, id long")
    got = rate_sample(df, sink="sink", at="at", rate=rate, epoch=0, order=["id"], workers=6)
    assert sorted(tuple(r) for r in got.collect()) == loop_sample(rows, rate, 0)


def test_sampler_with_a_hot_slot_after_a_pause(spark):
    rows = [(0, 10_000_000_000, i) for i in range(500)] + [(1, i * 100_000_000, 1000 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "sink long, at long, id long")
    got = rate_sample(df, sink="sink", at="at", rate=20, epoch=0, order=["id"], workers=8)
    assert sorted(tuple(r) for r in got.collect()) == loop_sample(rows, 20, 0)


def truncated(values, p):
    return sorted(values)[min(int(len(values) * p), len(values) - 1)]


def interpolated(values, p):
    x, n = sorted(values), len(values)
    pos = p * 100 * (n + 1) / 100
    if pos < 1:
        return x[0]
    if pos >= n:
        return x[-1]
    k = math.floor(pos)
    return x[k - 1] + (pos - k) * (x[k] - x[k - 1])


@pytest.mark.parametrize("method,rule", [("truncated", truncated), ("interpolated", interpolated)])
def test_percentiles_equal_sorted_lists(spark, method, rule):
    rng = random.Random(11)
    groups = {"one": [3.5], "two": [1.0, 2.0], "hot": [7.0] * 200 + [rng.random() * 10 for _ in range(100)],
              "wide": [rng.gauss(0, 1000) for _ in range(311)], "seven": [float(i) for i in range(7)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0) if method == "truncated" else (0.05, 0.25, 0.5, 0.75, 0.95)
    got = {(r["g"], r["prob"]): r["value"] for r in percentiles(df, "v", probs, by=["g"], method=method, block_values=70).collect()}
    assert len(got) == len(groups) * len(probs)
    for (g, p), value in got.items():
        assert value == pytest.approx(rule(groups[g], p), abs=1e-9), (g, p)


@pytest.mark.parametrize("method,rule", [("truncated", truncated), ("interpolated", interpolated)])
def test_percentiles_of_large_groups_order_little(spark, method, rule):
    """Groups beyond the small size, a null one among them, one with a hot value at a wanted place; and sketches that miss."""
    rng = random.Random(21)
    groups = {None: [rng.random() for _ in range(60_000)], "hot": [5.0] * 15_000 + [rng.gauss(5, 1) for _ in range(30_000)], "little": [rng.random() for _ in range(9)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    stats = quantiles.group_statistics(df, "v", PERCENTILES, ["g"]).cache()
    counts = quantiles._counted(df, "v", stats, ["g"], len(PERCENTILES), quantiles.SMALL)
    assert counts.count() < 600 and counts.agg(F.sum("_n")).first()[0] == df.count()
    for small, df2 in ((quantiles.SMALL, df), (0, df.where("g = 'little'"))):
        got = {(r["g"], r["prob"]): r["value"] for r in percentiles(df2, "v", by=["g"], method=method, small=small, block_values=100).collect()}
        assert len(got) == 5 * (3 if small else 1)
        for (g, p), value in got.items():
            assert value == pytest.approx(rule(groups[g], p), abs=1e-9), (g, p)


def test_summary_evaluates_its_samples_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    samples = spark.range(5000).select(F.lit("m").alias("metric"), F.col("id").cast("double").alias("v")).mapInArrow(counted, "metric string, v double")
    row = latency_summary(samples, "v", ["metric"]).first()
    assert (row["total"], row["0"], row["50"], row["100"]) == (5000, 0.0, 2500.0, 4999.0) and seen.value == 5000


def test_percentiles_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    got = {r["prob"]: r["value"] for r in percentiles(df, "v", (0.5, 0.95)).collect()}
    assert got == {0.5: 50.0, 0.95: 95.0}


def test_interpolated_rule_is_not_sparks(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(7)], "g string, v double")
    assert percentiles(df, "v", (0.05,), by=["g"], method="interpolated").first()["value"] == 0.0


def test_summary_counts_offered_values_and_skips_empty_sinks(spark):
    samples = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 3.0)], "metric string, sink long, v double")
    totals = spark.createDataFrame([("m", 0, 10), ("m", 1, 30), ("none", 2, 0)], "metric string, sink long, total long")
    row = latency_summary(samples, "v", ["metric"], totals=merge_totals(totals, ["metric"])).collect()
    assert len(row) == 1 and row[0]["total"] == 40 and row[0]["samples"] == 2 and row[0]["mean"] == 2.0
    assert row[0]["0"] == 1.0 and row[0]["100"] == 3.0 and row[0]["50"] == 3.0


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_total_over_many_blocks(spark, exclusive):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-5000, 50_000), 700))
    rows = [(i, rng.randrange(-5, 50), i % 3) for i in ids]
    df = spark.createDataFrame(rows, "id long, x long, g long")
    for by in ([], ["g"]):
        got = {r["id"]: r["t"] for r in running_total(df, F.col("x"), "id", "t", by=by, exclusive=exclusive, block_rows=8).collect()}
        sums, expected = {}, {}
        for i, x, g in rows:
            k = g if by else 0
            before = sums.get(k, 0)
            sums[k] = before + x
            expected[i] = before if exclusive else sums[k]
        assert got == expected
