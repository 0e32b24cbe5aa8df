"""The package on the executors, for the functions that run in their Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of the session's application, once."""
    context = spark.sparkContext
    home = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not home.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="weftline-")) / f"{home.name}.zip"
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(home.rglob("*.py")):
            file.write(source, source.relative_to(home.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
