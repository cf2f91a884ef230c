"""The package on executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_turn = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    with _turn:
        sc = spark.sparkContext
        if sc.applicationId in _shipped:
            return
        _shipped.add(sc.applicationId)
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quillmark-"), "quillmark_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
