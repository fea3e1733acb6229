"""A folder for stores that last as long as the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all machines share; under this machine's temporary folder only in local mode."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        there = tempfile.mkdtemp(prefix="keyloom-")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
