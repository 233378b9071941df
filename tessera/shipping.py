"""The package on the executors: functions that run in Python workers are found there by name."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the workers of a session, once: the driver serves it as an archive of its sources. Not needed where the
    package is installed on the executors (pyproject.toml) or their PYTHONPATH has it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    own = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(own)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(own)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
