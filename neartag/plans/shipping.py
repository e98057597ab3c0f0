"""Makes the package importable in Python workers on other machines."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add a zip of this package to the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="neartag-zip-")) / package.name
    sc.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _shipped.add(sc.applicationId)
