"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="chronoweave-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, "chronoweave_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for source in sorted(home.rglob("*.py")):
            bundle.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
