"""The package for executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors, as functions that run there are named by their modules.

    Not needed where it is installed on every machine, or on PYTHONPATH there.
    """
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
