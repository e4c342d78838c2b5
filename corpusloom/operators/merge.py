"""Union and deduplication of corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: Column, order: list[Column], unique: Column) -> DataFrame:
    """The first row of each key; rows without a key all stay (``unique`` sets them apart)."""
    within = Window.partitionBy(key, F.when(key.isNull(), unique)).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(within)).where("__rn = 1").drop("__rn")


def union_all(inputs: list[DataFrame]) -> DataFrame:
    """All rows with the number of their input."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("input_no", F.lit(k)) for k, df in enumerate(inputs)])


def merge(inputs: list[DataFrame]) -> DataFrame:
    """The first row of each id, by input, then position (idx); null and empty ids are ids like any other here."""
    rows = union_all(inputs)
    return first_per_key(rows, F.coalesce("id", F.lit("")), [F.col("input_no"), F.col("idx")], F.col("idx"))


def merged_source_counts(inputs: list[DataFrame]) -> DataFrame:
    """Entries a source before deduplication; only missing sources are ``unknown``, empty ones are counted apart."""
    return union_all(inputs).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("entries"))


def merged_metadata(metadata: list[dict], names: list[str]) -> tuple[dict, list[str]]:
    """(metadata, warnings): the first model that is named is kept, other ones are warned of."""
    models = [m.get("embedding_model") for m in metadata]
    named = [m for m in models if m]
    others = sorted({m for m in named if m != named[0]}) if named else []
    return {"embedding_model": named[0] if named else None, "merged_from": names}, [f"embedding model {m} differs from {named[0]}" for m in others]


def add_index(entries: DataFrame, more: DataFrame) -> DataFrame:
    """All rows of both, nothing dropped; the added rows' idx follows that of the others."""
    top = entries.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("__from"))
    return entries.unionByName(more.crossJoin(F.broadcast(top)).withColumn("idx", F.col("idx") + F.col("__from")).drop("__from"), allowMissingColumns=True)
