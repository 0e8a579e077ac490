"""Whole jobs put together from the operators: result roll-ups, experiments, the query catalogue."""
