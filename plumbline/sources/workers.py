"""The package's code for the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import plumbline

#: Applications whose Python workers have this package's code.
_SHIPPED: set[str] = set()


def ready_workers(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once."""
    app, package = spark.sparkContext.applicationId, Path(plumbline.__file__).parent
    if app in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-code-")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(Path("plumbline") / f.relative_to(package)))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
