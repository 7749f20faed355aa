"""Where indexes and tables of a query are kept: the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a temporary folder only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spherion-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"
