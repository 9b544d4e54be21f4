"""The package on every executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import assaylake

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once per application.

    Spark's own file server delivers it, so executors need neither the repository
    nor a shared path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(assaylake.__file__).parent
    folder = tempfile.mkdtemp(prefix="assaylake-code-")
    archive = os.path.join(folder, "assaylake_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("assaylake") / p.relative_to(root))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file until it ends
    _shipped.add(sc.applicationId)
