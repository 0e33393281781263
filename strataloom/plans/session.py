"""Making this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's source to the executors, once for each application; it needn't be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="strataloom-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
