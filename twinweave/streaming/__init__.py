"""Structured Streaming versions of the joins, and helpers to run them."""
