"""Operators of a large training-data pipeline: packing, deduplication, scoring, tokens and archives."""
