"""A folder for tables that queries write and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``).

    Where that is unset, a ``local`` master gets a temporary folder; a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom_")
    return f"{folder.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"
