"""Folders for what is written and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a temporary folder on a single machine (as in tests); on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.match(r"local(\[.*\])?$", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="glasspane-")
        base = _local[context.applicationId]
    return f"{base.rstrip('/')}/glasspane-{uuid.uuid4().hex}"
