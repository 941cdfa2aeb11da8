"""Getting this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the workers, once per application, unless PYTHONPATH or an installation has it there."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    installed = "site-packages" in str(root)
    if app in _sent or installed or any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    path = os.path.join(tempfile.mkdtemp(), "gridspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "gridspark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
