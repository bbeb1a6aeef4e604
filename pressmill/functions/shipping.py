"""The package's source for Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: functions of its modules are pickled by name."""
    sc = spark.sparkContext
    if getattr(sc, "_pressmill_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="pressmill-src-"), "pressmill_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    sc.addPyFile(target)
    sc._pressmill_shipped = True
