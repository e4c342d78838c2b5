"""Query op2: passages that documents repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chaining import repeated_passages
from .shared import table

NAME = "op2_collinear_chaining"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
