"""Query op4: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .scoring import labelled_sample, score_texts
from .shared import held_out, table

NAME = "op4_toxicity"


def fitted(spark: SparkSession, sf_dir: str, settings: toxicity.Settings = toxicity.Settings()) -> toxicity.Model:
    """The model of the labelled documents outside the held-out fold."""
    sample = labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", ~held_out(F.col("doc_id")), settings.most_rows)
    return toxicity.train(sample["text"].tolist(), sample["label"].tolist(), settings)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), fitted(spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
