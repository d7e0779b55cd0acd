"""Makes this package importable on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, so that a cluster needs no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    folder = tempfile.mkdtemp()  # the driver's file server reads it as long as the application runs
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(to := f"{folder}/leafmill_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    context.addPyFile(to)
    _shipped.add(context.applicationId)
