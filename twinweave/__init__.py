"""Keyed event-time joins of two inputs on Spark, and everything around them."""

from twinweave.operators.joins import interval_join, numeric_pair, sum_below, text_pair, window_join
from twinweave.operators.quantiles import percentiles
from twinweave.operators.sampling import rate_sample
from twinweave.session import get_session
from twinweave.streaming.joins import stream_interval_join, stream_window_join

__all__ = [
    "get_session", "interval_join", "numeric_pair", "percentiles", "rate_sample", "stream_interval_join",
    "stream_window_join", "sum_below", "text_pair", "window_join",
]
