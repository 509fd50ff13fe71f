"""Making this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import shelfwise

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors of this application, once.

    Spark's file server delivers them; a cluster needs neither a shared code folder nor
    an installed copy.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(shelfwise.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="shelfwise-code-")) / "shelfwise_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
