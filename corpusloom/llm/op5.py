"""Query op5: near-duplicates among all documents by 3-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ngram_jaccard import similar_documents
from .shared import table

NAME = "op5_ngram_jaccard"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), n=3, percent=70)
