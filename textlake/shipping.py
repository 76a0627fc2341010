"""Sending this package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless their Python finds it on the path that they share with the
    driver. Sent once a Spark application."""
    package = Path(__file__).resolve().parent
    root = str(package.parent)
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path(os.getcwd(), package.name).resolve() == package or context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="textlake-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
