"""Sends this package to the executors, so that functions in it can run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_graphnom_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="graphnom-")) / "graphnom_sources.zip"
    with zipfile.ZipFile(to, "w") as archive:
        for path in sorted(ROOT.rglob("*.py")):
            archive.write(path, path.relative_to(ROOT.parent))
    sc.addPyFile(str(to))
    sc._graphnom_shipped = True
