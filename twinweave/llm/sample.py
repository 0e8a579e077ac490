"""A bounded sample of labelled rows, chosen by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Labels a classifier is made for: of more, the most frequent ones (of equals the first in order) are learned.
MOST_LABELS = 256


def bounded(rows: DataFrame, label: str, keys: list[str], most: int, most_labels: int = MOST_LABELS) -> DataFrame:
    """About ``most`` different rows of each label (all of a rarer label): those with the least hash of ``keys``.

    One count per label decides the share of its rows; rows are then taken by their own hash, so no row is moved to be chosen, and
    the same rows are taken whatever the partitions. Repeated rows count once. At most ``most_labels`` counts come to the driver.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()
    if not counts:
        return rows.limit(0)
    part = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[label], int(min(1.0, most / r["count"]) * (1 << 30)))])
    return rows.where(part < F.try_element_at(share, F.col(label))).distinct()
