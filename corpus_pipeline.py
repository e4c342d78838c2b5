"""A corpus made ready for training: toxic documents out, near-duplicates out, benchmark leaks out, personal data
masked, sources mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next one. Rows
with null texts pass the stages as documents without words; the mix, which is the last, takes none of them. Rows that repeat
are judged alike, but for near_duplicates, which keeps one row of an id; rows with a null id pass it. Empty tables
give empty tables, and further columns are passed through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import op4, op10
from corpusloom.llm.decontamination import find_leaks
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.ngram_jaccard import similar_documents
from corpusloom.llm.scoring import score_texts
from corpusloom.llm.shared import BROADCAST_IDS, keep_ids, materialize, table

#: Stages hold code that SQL cannot express (models, fingerprints), so the pipeline is tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled documents finds toxic go."""
    scored = score_texts(docs, op4.fitted(spark, sf_dir), score="toxic_score")
    return scored.where("toxic_score < 0.5").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.7 of their word shingles, the one with the least id stays; of
    rows that repeat an id, the one with the least text."""
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    if repeated.limit(1).count():
        rest = F.to_json(F.struct(F.lit(0).alias("_"), *[docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]))  # columns of any type
        order = Window.partitionBy("doc_id").orderBy("text", rest)
        one = keep_ids(docs, repeated, "doc_id").withColumn("__n", F.row_number().over(order)).where("__n = 1").select(docs.columns)
        docs = keep_ids(docs, repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one)
    others = materialize(similar_documents(docs).where("doc_id <> component_id").select("doc_id"), "pipeline-duplicates")
    return keep_ids(docs, others, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return keep_ids(docs, materialize(leaks.select("doc_id").distinct(), "pipeline-leaks"), "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return op10.redact_rows(docs, op10.fitted(docs.select("doc_id", "text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (copies) and how many words that makes (taken)."""
    taken = materialize(mix_sources(docs).where("copies > 0").select("doc_id", "copies", "taken"), "pipeline-mix")
    if taken.count() <= BROADCAST_IDS:
        taken = F.broadcast(taken)
    return docs.join(taken, "doc_id").select(*docs.columns, "copies", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
