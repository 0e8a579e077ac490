"""Batch operators: joins, skew handling, ordered scans, sampling, summaries."""
