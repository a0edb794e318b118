"""Getting this package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once, unless workers find it by PYTHONPATH or the working folder."""
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.path.realpath(os.getcwd())}
    if str(root) in known or app in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="corploom-"), "corploom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "corploom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
