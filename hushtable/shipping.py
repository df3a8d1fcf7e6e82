"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of the session's executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    folder = Path(tempfile.mkdtemp(prefix="package-"))  # the driver serves it from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).parent
    shutil.copytree(package, folder / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "src"))
