"""Making this package importable on executors, once a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors; the archive itself is served by the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_grapheion_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    top = os.path.basename(root)
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, f"{top}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join(top, os.path.relpath(full, root)))
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._grapheion_shipped = True
