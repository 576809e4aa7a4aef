"""Bringing this package to the Python workers of executors that don't have it on their path."""

from __future__ import annotations

import shutil
import tempfile
import threading
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send the package once for each application, by the driver's own file server."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId not in _sent:
            here = Path(__file__).resolve().parent
            name = str(Path(tempfile.mkdtemp(prefix="kvloom-")) / "kvloom_package")
            sc.addPyFile(shutil.make_archive(name, "zip", here.parent, here.name))
            _sent.add(sc.applicationId)
