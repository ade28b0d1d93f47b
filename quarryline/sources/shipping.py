"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, unless their search path has it already."""
    app = spark.sparkContext.applicationId
    package = Path(__file__).resolve().parents[1]
    if app in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    at = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
