"""Gives the executors this package, for the operators that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the executors' path, once for each application, as an archive served by the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="docsql-")) / "docsql_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, path.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
