"""Inputs: dataset files, event-time assignment and replay, generated and live streams, result files."""
