"""The package on the executors, for operators whose tasks run its Python code."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import seasonloom

_SENT: set[str] = set()

# Bytes of an Arrow batch at most (a single row may be larger): several are under way in a
# task at a time, on both sides of the pipe.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shipped(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, and bound Arrow batches in bytes.

    Tasks unpickle functions by name.  Where the package is installed on every node this
    changes nothing; elsewhere the executors fetch it from the driver.
    """
    spark.conf.set(*_BATCH)
    application = spark.sparkContext.applicationId
    if application in _SENT:
        return
    root = os.path.dirname(os.path.realpath(seasonloom.__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="seasonloom-code-")), "seasonloom-code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.join("seasonloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(application)
