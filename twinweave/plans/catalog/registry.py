"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinweave.functions.clock import ntz_micros

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# --- the two streams all queries are about ---------------------------------------

HOUR = 3600 * 1_000_000
MINUTE = 60 * 1_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id, ts, user_id, event_type, amount`` with the time in us and ``value`` as a whole number."""
    return table(spark, sf, "events").select(
        "event_id", ntz_micros("ts").alias("ts"), "user_id", "event_type",
        F.floor("value").alias("value"), F.col("value").alias("amount"),
    )


def click_view(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The first and the second input of most joins."""
    rows = events(spark, sf)
    return rows.where("event_type = 'click'"), rows.where("event_type = 'view'")


def few_keys(spark: SparkSession, sf: str) -> DataFrame:
    """All events under five keys: long lists of rows per key."""
    return events(spark, sf).select("event_id", "ts", (F.col("user_id") % 5).alias("key"), "value")


def skewed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """All events under 20 keys of falling frequency."""
    return events(spark, sf).select(
        "event_id", "ts", "value", F.least(F.floor(F.col("amount") / 10), F.lit(19).cast("long")).alias("key"), "event_type"
    )


EVENTS_SQL = """ev AS (
    SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, CAST(floor(value) AS BIGINT) AS value, value AS amount FROM events),
  a AS (SELECT * FROM ev WHERE event_type = 'click'),
  b AS (SELECT * FROM ev WHERE event_type = 'view'),
  few AS (SELECT event_id, ts, user_id % 5 AS key, value FROM ev),
  skewed AS (SELECT event_id, ts, value, LEAST(CAST(floor(amount / 10) AS BIGINT), 19) AS key, event_type FROM ev)"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n  ".join([EVENTS_SQL, *ctes]) + "\n" + body


# Uniform draws in [0, 1) that other engines can compute as well.
def draw_1():
    return F.pmod(F.col("event_id") * 7919, F.lit(100003)).cast("double") / F.lit(100003.0)


def draw_2():
    return F.pmod(F.col("event_id") * 104729, F.lit(99991)).cast("double") / F.lit(99991.0)


DRAW_1_SQL = "(CAST((event_id * 7919) % 100003 AS DOUBLE) / 100003.0)"
DRAW_2_SQL = "(CAST((event_id * 104729) % 99991 AS DOUBLE) / 99991.0)"
