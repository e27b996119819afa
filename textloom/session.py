"""Sessions: sending this package to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to every executor's Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        home = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="textloom-package-")) / "textloom.zip"
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(home.rglob("*.py")):
                out.write(source, source.relative_to(home.parent))
        spark.sparkContext.addPyFile(str(path))
    return spark


def shipped(rows: DataFrame) -> DataFrame:
    """rows, with the package sent to the workers of their session: for operators on DataFrames that the library has not read itself."""
    ship(rows.sparkSession)
    return rows
