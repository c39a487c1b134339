"""Makes the package importable in every executor's Python."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application. addPyFile copies the archive to the driver's file server, from which executors fetch it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    staging = Path(tempfile.mkdtemp()) / f"loomkv_{sc.applicationId}.zip"
    with zipfile.ZipFile(staging, "w") as z:
        for p in sorted((root / "loomkv").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(staging))
    _shipped.add(sc.applicationId)
