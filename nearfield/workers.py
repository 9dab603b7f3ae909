"""Makes this package importable on Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to workers that would not find it on their path; once a context."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_nearfield_sent", False):
        return
    made = tempfile.mkdtemp(prefix="nearfield-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    # The driver serves this file to the executors; nothing reads it by its path.
    context.addPyFile(shutil.make_archive(f"{made}/nearfield", "zip", root, "nearfield"))
    context._nearfield_sent = True
