"""Query op3: the documents that hold benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontamination import find_leaks
from .shared import table

NAME = "op3_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
