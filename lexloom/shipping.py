"""Sends this package to the executors, so that a session finds it wherever it was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark serves the file to the executors."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lexloom-code-")) / "lexloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, str(Path("lexloom") / f.relative_to(root)))
    context.addPyFile(str(path))
    _SENT.add(context.applicationId)
