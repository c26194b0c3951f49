"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once a context, so that Python workers can import it from anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = os.path.dirname(os.path.abspath(__file__))
        made = os.path.join(tempfile.mkdtemp(), "tiltmine.zip")
        with zipfile.ZipFile(made, "w") as out:
            for folder, _, files in os.walk(home):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        out.write(full, os.path.join("tiltmine", os.path.relpath(full, home)))
        spark.sparkContext.addPyFile(made)
        _SHIPPED.add(app)
    return spark
