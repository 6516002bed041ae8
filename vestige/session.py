"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(name: str = "vestige", master: str | None = None, **conf: str) -> SparkSession:
    """A session with what the operators rely on: UTC, adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once an application."""
    app, here = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or str(here.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="vestige-")  # Spark reads the file for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "vestige.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(path))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
