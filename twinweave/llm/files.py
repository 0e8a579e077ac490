"""Binary files in the shared folder, written and read by tasks in byte ranges.

A task writes under a name of its own and reports the name as a row; only names in rows that Spark committed are ever read, so a task
that ran twice leaves a file that nobody looks at.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without scheme is a local one."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends to a new file below ``folder``; made at the first byte."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
        self.size = 0
        self._stream = None

    def write(self, data: bytes) -> None:
        if self._stream is None:
            system, path = opened(self.uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self._stream = system.open_output_stream(path, compression=None)
        self._stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self._stream is not None:
            self._stream.close()
            self._stream = None


class Reader:
    def __init__(self, uri: str):
        system, path = opened(uri)
        self._file = system.open_input_file(path)
        self.size = self._file.size()

    def range(self, start: int, stop: int) -> bytes:
        start, stop = max(0, start), min(stop, self.size)
        return self._file.read_at(stop - start, start) if stop > start else b""

    def close(self) -> None:
        self._file.close()


def spread(df: DataFrame, rows: int, most: int = 20_000) -> DataFrame:
    """Few small rows that each stand for much work: a task for each, as far as ``most`` goes."""
    return df.repartition(max(1, min(rows, most)))


def splits(files: DataFrame, split_bytes: int) -> DataFrame:
    """``path, start, stop``: byte ranges of files (``path, size``), dealt evenly to tasks."""
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0
    return spread(ranges.select("path", "start", F.least("size", F.col("start") + split_bytes).alias("stop")), int(n))
