"""Sends this package's code to the executors, for clusters on which it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to what Spark's Python workers import from, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = os.path.dirname(os.path.abspath(__file__))
        at = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella_code.zip")
        with zipfile.ZipFile(at, "w") as z:
            for d, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(d, n), os.path.join(os.path.basename(top), os.path.relpath(os.path.join(d, n), top)))
        spark.sparkContext.addPyFile(at)
        _sent.add(app)
    return spark
