"""The package on the executors, for operators whose tasks run Python."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark context, so that their Python workers
    find it wherever they start. Where it was itself sent as an archive there is nothing to do."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if package.is_dir() and not getattr(context, "_glasspane_shipped", False):
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='glasspane-')}/{package.name}", "zip", package.parent, package.name))
        context._glasspane_shipped = True
