"""Making this package importable in Python workers that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import weirflow

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the session's executors, once per application. Spark's own file server hands it on."""
    application = spark.sparkContext.applicationId
    if application in _done:
        return
    root = os.path.dirname(os.path.abspath(weirflow.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="weirflow-"), "weirflow_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _done.add(application)
