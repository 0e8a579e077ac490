"""Interval and window joins, and where their rows go."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.functions.clock import ntz_micros
from twinweave.model import PAIR_SUM_LIMIT
from twinweave.operators.joins import interval_join, numeric_pair, sum_below, text_pair, window_join
from twinweave.plans.catalog.registry import HOUR, MINUTE, click_view, events, few_keys, query, skewed_keys, sql, table
from twinweave.plans.experiments import comparison_join, comparison_streams
from twinweave.session import durable

DAY = 24 * HOUR


def ids(a, b):
    return [a.user_id.alias("user_id"), a.event_id.alias("a_id"), b.event_id.alias("b_id"),
            F.greatest(a.ts, b.ts).alias("ts")]


IDS_SQL = "a.user_id, a.event_id AS a_id, b.event_id AS b_id, GREATEST(a.ts, b.ts) AS ts"
SIX_HOURS = f"b.ts BETWEEN a.ts - {6 * HOUR} AND a.ts + {6 * HOUR}"


@query("j1_interval_click_view", sql(f"SELECT {IDS_SQL} FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"))
def interval_click_view(spark, sf):
    return interval_join(*click_view(spark, sf), "user_id", "ts", "ts", -6 * HOUR, 6 * HOUR, select=ids, row_id="event_id")


@query("j1_interval_orders_lineitem", f"""
  SELECT o_orderkey AS orderkey, l_linenumber AS linenumber, epoch_us(o_orderdate) AS ordered, epoch_us(l_shipdate) AS shipped
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
   AND epoch_us(l_shipdate) BETWEEN epoch_us(o_orderdate) AND epoch_us(o_orderdate) + {30 * DAY}""")
def interval_orders_lineitem(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), ntz_micros("o_orderdate").alias("at"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), ntz_micros("l_shipdate").alias("at"))
    return interval_join(
        orders, lines, "orderkey", "at", "at", 0, 30 * DAY, strategy="key",  # a key is one order: a handful of rows
        select=lambda a, b: [a.orderkey.alias("orderkey"), b.linenumber.alias("linenumber"), a["at"].alias("ordered"), b["at"].alias("shipped")],
    )


@query("j2_interval_theta", sql(f"""
  SELECT a.user_id, a.value + b.value AS value, GREATEST(a.ts, b.ts) AS ts
  FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS} AND a.value + b.value < {PAIR_SUM_LIMIT}"""))
def interval_theta(spark, sf):
    return interval_join(*click_view(spark, sf), "user_id", "ts", "ts", -6 * HOUR, 6 * HOUR,
                         select=numeric_pair("user_id"), where=sum_below(PAIR_SUM_LIMIT), row_id="event_id")


@query("j3_interval_backward", sql(f"SELECT {IDS_SQL} FROM a JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - {6 * HOUR} AND a.ts"))
def interval_backward(spark, sf):
    return interval_join(*click_view(spark, sf), "user_id", "ts", "ts", -6 * HOUR, 0, select=ids, row_id="event_id")


@query("j4_tumbling_join", sql(f"""
  SELECT {IDS_SQL}, a.ts // {6 * HOUR} * {6 * HOUR} AS w_start
  FROM a JOIN b ON a.user_id = b.user_id AND a.ts // {6 * HOUR} = b.ts // {6 * HOUR}"""))
def tumbling_join(spark, sf):
    return window_join(*click_view(spark, sf), "user_id", "ts", "ts", 6 * HOUR, select=ids, row_id="event_id")


def _windows_sql(size: int, slide: int) -> str:
    """Each row once per window it is in, and then a plain join on key and window."""
    last = max(1, -(-size // slide))
    assign = """SELECT x.*, (x.ts // {slide} - k) * {slide} AS w_start FROM {x} x, range({last}) r(k)
      WHERE x.ts < (x.ts // {slide} - k) * {slide} + {size}"""
    return sql(
        f"SELECT {IDS_SQL}, a.w_start FROM wa a JOIN wb b ON a.user_id = b.user_id AND a.w_start = b.w_start",
        f"wa AS ({assign.format(x='a', slide=slide, size=size, last=last)})",
        f"wb AS ({assign.format(x='b', slide=slide, size=size, last=last)})",
    )


@query("j5_sliding_join", _windows_sql(6 * HOUR, 2 * HOUR))
def sliding_join(spark, sf):
    return window_join(*click_view(spark, sf), "user_id", "ts", "ts", 6 * HOUR, 2 * HOUR, select=ids, row_id="event_id")


@query("j5_sliding_join_uneven", _windows_sql(5 * HOUR, 2 * HOUR))
def sliding_join_uneven(spark, sf):
    return window_join(*click_view(spark, sf), "user_id", "ts", "ts", 5 * HOUR, 2 * HOUR, select=ids, row_id="event_id")


@query("j5_hopping_gap_join", _windows_sql(2 * HOUR, 6 * HOUR))
def hopping_gap_join(spark, sf):
    return window_join(*click_view(spark, sf), "user_id", "ts", "ts", 2 * HOUR, 6 * HOUR, select=ids, row_id="event_id")


ROUND_ROBIN_SQL = """
WITH n AS (SELECT count(*) AS n FROM events),
  pos_a AS (SELECT event_id AS i FROM events),
  pos_b AS (SELECT event_id + k * (SELECT n FROM n) AS i FROM events, range(2) r(k)),
  sa AS (SELECT 'key_' || (i % 10) AS key, CAST(i * 2 AS VARCHAR) AS value, i * 2 AS ts FROM pos_a),
  sb AS (SELECT 'key_' || (i % 10) AS key, CAST(i AS VARCHAR) AS value, i AS ts FROM pos_b)"""


@query("j5_string_concat_join", ROUND_ROBIN_SQL + """
  SELECT sa.key, sa.value || sb.value AS value, GREATEST(sa.ts, sb.ts) + 125 AS event_ms, (sa.ts + 125) // 100 * 100000 AS w_start
  FROM sa JOIN sb ON sa.key = sb.key AND (sa.ts + 125) // 100 = (sb.ts + 125) // 100
   AND (sa.ts + 125) % 100 < 5 AND (sb.ts + 125) % 100 < 5""")
def string_concat_join(spark, sf):
    base, probe = comparison_streams(table(spark, sf, "events").select(F.col("event_id").alias("row_id")), num_keys=10)
    return comparison_join(base, probe, window_us=5000, slide_us=100_000)


ODD_WINDOW = 6 * HOUR + 1


@query("j6_window_in_micros", sql(f"""
  SELECT {IDS_SQL}, a.ts // {ODD_WINDOW} * {ODD_WINDOW} AS w_start
  FROM a JOIN b ON a.user_id = b.user_id AND a.ts // {ODD_WINDOW} = b.ts // {ODD_WINDOW}"""))
def window_in_micros(spark, sf):
    """A window length of no whole number of ms is kept to the microsecond."""
    return window_join(*click_view(spark, sf), "user_id", "ts", "ts", ODD_WINDOW, select=ids, row_id="event_id")


def pair_ids(a, b):
    return [a["key"].alias("key"), a.event_id.alias("a_id"), b.event_id.alias("b_id")]


#: A few keys over a fixed span of time get denser as the table grows. What is near shrinks with it, so that a row keeps its number of partners:
#: ten minutes among 10,000 events.
NEAR = 10 * MINUTE * 10_000
NEAR_SQL = f"(SELECT {NEAR} // count(*) FROM ev)"


def _few_sql(rows: str, near: str | int = NEAR_SQL) -> str:
    return sql(f"""SELECT x.key, x.event_id AS a_id, y.event_id AS b_id FROM {rows} x JOIN {rows} y
      ON x.key = y.key AND y.ts BETWEEN x.ts - {near} AND x.ts + {near}""")


def _span(rows):
    return NEAR // max(1, rows.count())


def _near(rows, strategy, span=None, **options):
    span = _span(rows) if span is None else span
    return interval_join(rows, rows, "key", "ts", "ts", -span, span, strategy=strategy, select=pair_ids, row_id="event_id", a_row_id="event_id", **options)


@query("j7_interval_key", sql(f"SELECT {IDS_SQL} FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"))
def interval_key(spark, sf):
    """Many keys with few rows each: the case key partitioning is made for."""
    return interval_join(*click_view(spark, sf), "user_id", "ts", "ts", -6 * HOUR, 6 * HOUR, select=ids, strategy="key")


@query("j8_interval_data", _few_sql("few", 10 * MINUTE))
def interval_data(spark, sf):
    """Ten minutes, however many events there are: every pair comes out, and denser events have more of them."""
    return _near(few_keys(spark, sf), "data", span=10 * MINUTE)


@query("j9_interval_hybrid", _few_sql("skewed"))
def interval_hybrid(spark, sf):
    return _near(skewed_keys(spark, sf), "hybrid", workers=8)


@query("j9_interval_hybrid_whole_keys", _few_sql("skewed"))
def interval_hybrid_whole_keys(spark, sf):
    """Hot keys found by key probability alone; all their cells are split."""
    return _near(skewed_keys(spark, sf), "hybrid", workers=8, split_by="key")


@query("j9_tumbling_hybrid", sql(f"""SELECT x.key, x.event_id AS a_id, y.event_id AS b_id, x.ts // size * size AS w_start
  FROM skewed x, (SELECT 6 * {NEAR_SQL} AS size) JOIN skewed y ON x.key = y.key AND x.ts // size = y.ts // size"""))
def tumbling_hybrid(spark, sf):
    rows = skewed_keys(spark, sf)
    return window_join(rows, rows, "key", "ts", "ts", 6 * _span(rows), select=pair_ids, strategy="hybrid", workers=8, row_id="event_id")


def _heavy_first(spark, sf):
    """All events against the first of each user: many rows against few on every hot key."""
    rows = skewed_keys(spark, sf)
    user = events(spark, sf).select(F.col("event_id").alias("id"), "user_id")
    first = rows.join(user, F.col("event_id") == F.col("id")).groupBy("user_id").agg(
        F.min_by(F.struct("event_id", "ts", "value", "key", "event_type"), "event_id").alias("r"))
    return rows, durable(first.select("r.*"))


FIRSTS = f"""firsts AS (SELECT s.* FROM skewed s JOIN (SELECT min(event_id) AS event_id FROM ev GROUP BY user_id) USING (event_id))"""


@query("j9_interval_hybrid_heavy_first", sql(f"""SELECT x.key, x.event_id AS a_id, y.event_id AS b_id FROM skewed x JOIN skewed y
  ON x.key = y.key AND y.ts BETWEEN x.ts - 6 * {NEAR_SQL} AND x.ts + 6 * {NEAR_SQL}""".replace("skewed y", "firsts y"), FIRSTS))
def interval_hybrid_heavy_first(spark, sf):
    """The first input has several times the rows of the second on every hot key."""
    a, b = _heavy_first(spark, sf)
    span = 6 * _span(a)
    return interval_join(a, b, "key", "ts", "ts", -span, span, strategy="hybrid", workers=8, select=pair_ids, row_id="event_id", a_row_id="event_id")


@query("j9_tumbling_hybrid_heavy_first", sql(f"""SELECT x.key, x.event_id AS a_id, y.event_id AS b_id, x.ts // size * size AS w_start
  FROM skewed x, (SELECT 6 * {NEAR_SQL} AS size) JOIN firsts y ON x.key = y.key AND x.ts // size = y.ts // size""", FIRSTS))
def tumbling_hybrid_heavy_first(spark, sf):
    a, b = _heavy_first(spark, sf)
    return window_join(a, b, "key", "ts", "ts", 6 * _span(a), select=pair_ids, strategy="hybrid", workers=8, row_id="event_id", a_row_id="event_id")


@query("j10_interval_bucket_few_keys", _few_sql("few"))
def interval_bucket(spark, sf):
    return _near(few_keys(spark, sf), "bucket")


@query("j10_interval_auto_skewed", _few_sql("skewed"))
def interval_auto(spark, sf):
    return _near(skewed_keys(spark, sf), "auto")


@query("j11_self_interval", sql(f"""SELECT x.user_id, x.event_id AS a_id, y.event_id AS b_id, GREATEST(x.ts, y.ts) AS ts FROM ev x JOIN ev y
  ON x.user_id = y.user_id AND y.ts BETWEEN x.ts - {HOUR} AND x.ts + {HOUR}"""))
def self_interval(spark, sf):
    rows = events(spark, sf)
    return interval_join(rows, rows, "user_id", "ts", "ts", -HOUR, HOUR, select=ids, row_id="event_id")


# --- keys, filters and projections of a join --------------------------------------

@query("f1_key_selector", sql(f"""SELECT x.user_id, x.event_type, x.event_id AS a_id, y.event_id AS b_id FROM ev x JOIN ev y
  ON x.user_id = y.user_id AND x.event_type = y.event_type AND y.ts BETWEEN x.ts AND x.ts + {HOUR}"""))
def key_selector(spark, sf):
    """A key of two columns."""
    rows = events(spark, sf)
    return interval_join(rows, rows, ["user_id", "event_type"], "ts", "ts", 0, HOUR, row_id="event_id", select=lambda a, b: [
        a.user_id.alias("user_id"), a.event_type.alias("event_type"), a.event_id.alias("a_id"), b.event_id.alias("b_id")])


@query("f2_filter", sql("SELECT event_id, user_id, value FROM ev WHERE value >= 5"))
def row_filter(spark, sf):
    return events(spark, sf).where(F.col("value") >= 5).select("event_id", "user_id", "value")


@query("f3_pair_filter", sql(f"""SELECT x.user_id, x.value + y.value AS value, GREATEST(x.ts, y.ts) AS ts, x.ts // {HOUR} * {HOUR} AS w_start
  FROM ev x JOIN ev y ON x.user_id = y.user_id AND x.ts // {HOUR} = y.ts // {HOUR} AND x.value + y.value < {PAIR_SUM_LIMIT}"""))
def pair_filter(spark, sf):
    rows = events(spark, sf)
    return window_join(rows, rows, "user_id", "ts", "ts", HOUR, select=numeric_pair("user_id"), where=sum_below(PAIR_SUM_LIMIT), row_id="event_id")


@query("f4_pair_projection", sql(f"""SELECT a.user_id, a.value + b.value AS value, GREATEST(a.ts, b.ts) AS ts
  FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"""))
def pair_projection(spark, sf):
    return interval_join(*click_view(spark, sf), "user_id", "ts", "ts", -6 * HOUR, 6 * HOUR, select=numeric_pair("user_id"), row_id="event_id")


@query("f5_text_projection", sql(f"""SELECT 'key_' || a.user_id AS key, CAST(a.event_id AS VARCHAR) || CAST(b.event_id AS VARCHAR) AS value,
  GREATEST(a.ts, b.ts) AS ts FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"""))
def text_projection(spark, sf):
    def strings(df):
        return df.select(F.concat(F.lit("key_"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), "ts")
    a, b = click_view(spark, sf)
    return interval_join(strings(a), strings(b), "key", "ts", "ts", -6 * HOUR, 6 * HOUR, select=text_pair())


@query("x1_pair_function", sql(f"""SELECT a.user_id, a.value * b.value AS product, b.ts - a.ts AS gap_us
  FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS}"""))
def pair_function(spark, sf):
    return interval_join(*click_view(spark, sf), "user_id", "ts", "ts", -6 * HOUR, 6 * HOUR, row_id="event_id", select=lambda a, b: [
        a.user_id.alias("user_id"), (a.value * b.value).alias("product"), (b.ts - a.ts).alias("gap_us")])


@query("x2_optional_pair_function", sql(f"""SELECT a.user_id, a.value * b.value AS product
  FROM a JOIN b ON a.user_id = b.user_id AND {SIX_HOURS} AND a.value > b.value"""))
def optional_pair_function(spark, sf):
    return interval_join(*click_view(spark, sf), "user_id", "ts", "ts", -6 * HOUR, 6 * HOUR, row_id="event_id",
                         where=lambda a, b: a.value > b.value,
                         select=lambda a, b: [a.user_id.alias("user_id"), (a.value * b.value).alias("product")])


@query("x3_key_and_filter_functions", sql(f"""SELECT x.user_id % 5 AS key, x.event_id AS a_id, y.event_id AS b_id FROM ev x JOIN ev y
  ON x.user_id % 5 = y.user_id % 5 AND y.ts BETWEEN x.ts AND x.ts + {NEAR_SQL} // 10 WHERE x.value >= 5 AND y.value >= 5"""))
def key_and_filter_functions(spark, sf):
    every = few_keys(spark, sf)
    rows = every.where(F.col("value") >= 5)
    return interval_join(rows, rows, "key", "ts", "ts", 0, _span(every) // 10, select=pair_ids, row_id="event_id")
