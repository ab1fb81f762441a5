"""Send this package to the executors, as --py-files would, for the Python functions that Spark runs there."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once for each application. Unless the session says otherwise, batches for Python are of some megabytes, as texts may be long: they are held several times."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "4m")
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="helix-")
    try:
        path = os.path.join(folder, "helix_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, f"helix/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(path)
        _SENT.add(app)
    except OSError:
        shutil.rmtree(folder, ignore_errors=True)
        raise
