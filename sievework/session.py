"""Session helpers: make this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers once an application, unless PYTHONPATH already leads them to it."""
    root = Path(__file__).resolve().parent.parent
    if any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    into = tempfile.mkdtemp(prefix="sievework-zip-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{into}/sievework", "zip", root, "sievework"))
    atexit.register(shutil.rmtree, into, ignore_errors=True)
    _shipped.add(app)
