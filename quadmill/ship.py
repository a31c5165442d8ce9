"""Executors get this package with the first job that needs it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source (a few hundred KB) to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    _done.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    # on the driver only: Spark serves the file from there, until the driver ends
    folder = tempfile.mkdtemp(prefix="quadmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quadmill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("quadmill", os.path.relpath(full, root)))
    context.addPyFile(path)
