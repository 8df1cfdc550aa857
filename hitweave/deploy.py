"""Ships this package to the executors of a running session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application.

    Kernels are pickled by reference, so every executor must be able to import them, also where
    only the driver has the package on its path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="hitweave-"), "hitweave.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(p for p in root.rglob("*") if p.suffix in (".py", ".txt")):
            z.write(path, path.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
