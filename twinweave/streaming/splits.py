"""Grids of hot keys that belong to a streaming query: stored beside its checkpoint, and valid from a point in event time on.

State that is stored cannot follow a grid that changes. So a grid is chosen by the time of the *cell* in which two rows meet (the start of their
bucket or window), not by when a query was started: both inputs see the same time there and so agree, whatever is known later. A log holds
*epochs*: from which time on, and the grids of the keys that are hot from then. New epochs only ever begin behind all rows that have arrived.

An epoch counts once its line is in the manifest; grids without a line are what a broken attempt left and are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinweave.functions.integers import as_long
from twinweave.model import BALANCE_LIMIT
from twinweave.operators import heavy

#: Keys of all epochs together; their table is broadcast in every micro-batch.
MOST_SPLIT_KEYS = 100_000
_EPOCHS = "epoch long, valid_from long, attempt string"
_GRIDS = "cell long, splits_a long, splits_b long"
_BEGINNING = -(1 << 63)


class SplitLog:
    """The grids of one query in ``folder`` (below the shared folder, as its checkpoint).

    Epochs are added while the query is stopped: ``start`` before its first run, ``extend`` between two runs. A restarted query always goes on with what is stored.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: str | Sequence[str]):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.keys = [keys] if isinstance(keys, str) else list(keys)

    def epochs(self) -> list[tuple[int, int, str]]:
        """``epoch, valid_from, attempt`` in order; a line per restart at most."""
        if not self._exists(f"{self.folder}/epochs"):
            return []
        return sorted(tuple(r) for r in self.spark.read.schema(_EPOCHS).parquet(f"{self.folder}/epochs").collect())

    def table(self) -> DataFrame:
        """``epoch, cell, splits_a, splits_b`` of all epochs."""
        rows = self.spark.createDataFrame([], "epoch long, " + _GRIDS)
        for epoch, _, attempt in self.epochs():
            rows = rows.unionByName(self.spark.read.schema(_GRIDS).parquet(f"{self.folder}/grids/{attempt}").select(as_long(epoch).alias("epoch"), "*"))
        return rows

    def start(self, grids: DataFrame | Sequence[tuple[int, int, int]]) -> bool:
        """The first epoch, for all times. A log that has epochs keeps them: False then, and ``grids`` is not used."""
        if self.epochs():
            return False
        self._add(0, _BEGINNING, grids)
        return True

    def start_from(self, a: DataFrame, b: DataFrame, workers: int, threshold: float = BALANCE_LIMIT, max_split: int | None = None) -> bool:
        """The first epoch from the key frequencies of two tables like the streams, found by one job."""
        return False if self.epochs() else self.start(self.hot(a, b, workers, threshold, max_split))

    def extend(self, grids: DataFrame | Sequence[tuple[int, int, int]], valid_from: int) -> None:
        """An epoch for cells that begin at ``valid_from`` (us) or later. No row of such a cell may have been read yet."""
        known = self.epochs()
        if not known:
            raise ValueError("the log has no first epoch")
        if valid_from <= known[-1][1]:
            raise ValueError(f"an epoch must begin after {known[-1][1]}")
        self._add(known[-1][0] + 1, valid_from, grids)

    def extend_from(self, a: DataFrame, b: DataFrame, a_time: str, b_time: str, reach_us: int, workers: int, *, since_us: int | None = None,
                    threshold: float = BALANCE_LIMIT, max_split: int | None = None) -> int:
        """An epoch from what has arrived: ``a`` and ``b`` hold at least all rows the query can have read.

        It holds for cells that begin more than ``reach_us`` (the upper bound of the interval, 0 for windows) after the last of them; that
        time is returned. Only rows from ``since_us`` on are looked at for hot keys.
        """
        known = self.epochs()
        times = [df.agg(F.max(F.unix_micros(F.col(c).cast("timestamp"))).alias("t")).first()["t"] for df, c in ((a, a_time), (b, b_time))]
        last = max([t for t in times if t is not None], default=None)
        if last is None or not known:
            raise ValueError("nothing has arrived, or the log has no first epoch")
        valid_from = max(last + max(0, reach_us) + 1, known[-1][1] + 1)
        if since_us is not None:
            a, b = (df.where(F.unix_micros(F.col(c).cast("timestamp")) >= as_long(since_us)) for df, c in ((a, a_time), (b, b_time)))
        self.extend(self.hot(a, b, workers, threshold, max_split), valid_from)
        return valid_from

    def hot(self, a: DataFrame, b: DataFrame, workers: int, threshold: float = BALANCE_LIMIT, max_split: int | None = None) -> list[tuple[int, int, int]]:
        """``cell, splits_a, splits_b`` of the keys that hold more than their part of both tables; fewer than ``workers / threshold``."""
        cells = heavy.paired_cells(a, b, [(k, k) for k in self.keys])
        if cells is None:
            raise ValueError("the key columns of both inputs must have one type")
        found = heavy.heavy_cells(*(df.select(c.alias("cell")) for df, c in zip((a, b), cells)), workers, threshold, pairs=False)
        return heavy.grids(found, workers, threshold, max_split)

    def from_table(self, splits: DataFrame, like: DataFrame) -> DataFrame:
        """``cell, splits_a, splits_b`` of a table of keys with ``splits_a, splits_b`` whose key columns become those of the stream ``like``."""
        kinds = {f.name: f.dataType for f in like.schema}
        typed = splits.select(*[F.col(k).cast(kinds[k]).alias(k) for k in self.keys], "splits_a", "splits_b")
        cell, _ = heavy.paired_cells(typed, typed, [(k, k) for k in self.keys])
        return typed.select(cell.alias("cell"), F.col("splits_a").cast("long").alias("splits_a"), F.col("splits_b").cast("long").alias("splits_b"))

    def bind(self, checkpoint: str) -> None:
        """Tie the log to the checkpoint of its query; refuses one that has state from before the log was there."""
        place = f"{self.folder}/checkpoints"
        known = self._exists(place) and self.spark.read.schema("checkpoint string").parquet(place).where(F.col("checkpoint") == checkpoint).count() > 0
        if known:
            return
        if self._exists(f"{checkpoint}/commits/0"):
            raise RuntimeError("the checkpoint holds state that was placed without this split log")
        self.spark.createDataFrame([(checkpoint,)], "checkpoint string").coalesce(1).write.mode("append").parquet(place)

    def grid(self, rows: DataFrame, cell: Column, at_us: Column | None, name: str) -> DataFrame:
        """``rows`` with ``{name}a`` and ``{name}b``: the grid of each row's cell at the time the cell begins."""
        known = self.epochs()
        if at_us is None and len(known) > 1:
            raise ValueError("grids that change need time buckets")
        table = self.table()
        count = table.count()
        if count > MOST_SPLIT_KEYS:
            raise ValueError(f"more than {MOST_SPLIT_KEYS} keys are split")
        from_ = F.array(*[as_long(v) for _, v, _ in known])
        epoch = as_long(0) if at_us is None else F.size(F.filter(from_, lambda v: v <= at_us)).cast("long") - 1
        mine = F.broadcast(table.select(F.col("epoch").alias("_epoch"), F.col("cell").alias("_key"), F.col("splits_a").alias(f"{name}a"), F.col("splits_b").alias(f"{name}b")))
        found = rows.withColumns({"_own_cell": cell, "_own_epoch": epoch}).join(mine, (F.col("_own_cell") == F.col("_key")) & (F.col("_own_epoch") == F.col("_epoch")), "left")
        one = as_long(1)
        return found.withColumns({f"{name}{c}": F.coalesce(f"{name}{c}", one) for c in "ab"}).drop("_own_cell", "_own_epoch", "_epoch", "_key")

    def _add(self, epoch: int, valid_from: int, grids: DataFrame | Sequence[tuple[int, int, int]]) -> None:
        rows = grids if isinstance(grids, DataFrame) else self.spark.createDataFrame(list(grids), _GRIDS)
        attempt = uuid.uuid4().hex
        rows.select("cell", "splits_a", "splits_b").write.parquet(f"{self.folder}/grids/{attempt}")
        self.spark.createDataFrame([(epoch, valid_from, attempt)], _EPOCHS).coalesce(1).write.mode("append").parquet(f"{self.folder}/epochs")

    def _exists(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
