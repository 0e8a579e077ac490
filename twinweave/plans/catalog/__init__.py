"""The query catalogue: importing it registers all queries."""

from twinweave.plans.catalog import inputs, joins, results, statistics, streams  # noqa: F401
from twinweave.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
