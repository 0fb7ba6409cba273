"""Geoscience archive analytics and text-corpus preparation on PySpark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="aeolis-")) / "aeolis.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, p.relative_to(here.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
