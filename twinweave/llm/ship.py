"""The package for the executors' Python, as ``spark-submit --py-files`` would give it."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from twinweave.llm.files import Writer
from twinweave.session import fresh_dir

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put the package's sources in the shared folder and name them to the session's tasks, once per application."""
    application = spark.sparkContext.applicationId
    if application in _done:
        return
    root = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    now = Writer(fresh_dir(spark, "package"), ".zip")
    now.write(held.getvalue())
    now.close()
    spark.sparkContext.addPyFile(now.uri)
    _done.add(application)
