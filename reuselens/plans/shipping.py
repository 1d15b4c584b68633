"""The package itself, sent to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Once per context: Python workers import the package from a zip that Spark distributes."""
    sc = spark.sparkContext
    if getattr(sc, "_reuselens_shipped", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="reuselens-")), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    sc._reuselens_shipped = True
