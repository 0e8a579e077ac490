"""Record layouts. Keys, values and times are LONG throughout, so sums never overflow an int."""

from __future__ import annotations

from pyspark.sql import types as T

#: One row of a dataset file: ``ts_off`` is the gap in ms to the row before it.
FILE_ROW = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("value", T.LongType()),
    T.StructField("ts_off", T.LongType()),
])

#: A numeric stream record: event time in us, ingest time in ns.
NUMERIC_RECORD = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("value", T.LongType()),
    T.StructField("event_us", T.LongType()),
    T.StructField("ingest_ns", T.LongType()),
])

#: A string stream record: ``ts`` in ms.
STRING_RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("ts", T.LongType()),
])

#: One measured latency.
LATENCY_SAMPLE = T.StructType([
    T.StructField("sink_id", T.LongType()),
    T.StructField("at_ns", T.LongType()),
    T.StructField("latency_us", T.DoubleType()),
])

#: The percentile columns of a result record, "0" is the minimum and "100" the maximum.
PERCENTILE_NAMES = ("0", "5", "25", "50", "75", "95", "100")
#: The ranks computed between minimum and maximum.
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)

#: The summary of one run as it is stored in a result file.
METRIC_RESULT = T.StructType(
    [T.StructField("total", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("mean", T.DoubleType())]
    + [T.StructField(name, T.DoubleType()) for name in PERCENTILE_NAMES]
)

#: Fixed value: first event time of file-driven interval-join streams, ms (2024-01-01 11:00 UTC).
EVENT_TIME_BASE_MS = 1704106800000
#: Fixed value: gap that stands for an offset of 0 in a dataset file, ms.
ZERO_OFFSET_MS = 500
#: Fixed value: largest generated gap, ms.
MAX_OFFSET_MS = 500
#: Fixed value: shift of every event of the string streams, ms.
STRING_STREAM_SHIFT_MS = 125
#: Fixed value: a pair passes the default value filter when the sum of values is below this.
PAIR_SUM_LIMIT = 11
#: Fixed value: balance (max load / average load) that counts as even enough.
BALANCE_LIMIT = 1.2
#: Fixed value: run length, seconds.
RUN_SECONDS = 60
#: Fixed value: value of every row of the constant-valued sources.
CONSTANT_VALUE = 5
#: Seeds of the two generated inputs, default row count and skew.
SEED_A, SEED_B = 12345, 54321
DEFAULT_ROWS = 2_000_000
DEFAULT_SKEW = 0.8
#: Fixed value: latency samples per second and sink.
SAMPLES_PER_SECOND = 250
