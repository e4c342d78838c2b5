"""Entries: the row type of a corpus, and how rows of other forms become entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields an entry may carry in files, in order; everything else is dropped on reading.
FIELDS = ("id", "text", "source", "title", "date", "metadata", "content_hash", "embedding")

FILE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("id", "text", "source", "title", "date")]
    + [T.StructField("metadata", T.VariantType()), T.StructField("content_hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def is_valid() -> Column:
    """Entries need an id and a text that are neither null nor empty."""
    return F.coalesce((F.col("id") != "") & (F.col("text") != ""), F.lit(False))


def as_entries(df: DataFrame) -> DataFrame:
    """All fields in order, absent ones null; unknown columns dropped; ids as strings; null metadata as ``{}``."""
    have = {c.lower(): c for c in df.columns}
    columns = []
    for f in FILE_SCHEMA:
        if f.name not in have:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "metadata" else F.parse_json(F.lit("{}")).alias("metadata"))
        elif f.name == "metadata":
            kind = df.schema[have["metadata"]].dataType
            value = F.col("metadata") if isinstance(kind, T.VariantType) else F.parse_json(F.col("metadata")) if isinstance(kind, T.StringType) else F.to_variant_object("metadata")
            columns.append(F.when(F.coalesce(F.is_variant_null(value), F.lit(True)), F.parse_json(F.lit("{}"))).otherwise(value).alias("metadata"))
        else:
            columns.append(F.col(f"`{have[f.name]}`").cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in ("idx", "date_parsed") if c in have]
    return df.select(*columns, *extra)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row without null fields and without empty metadata (column ``value``)."""
    body = [F.col(c) if c != "metadata" else F.when(F.to_json("metadata") != "{}", F.col("metadata")).alias("metadata") for c in FIELDS if c in df.columns]
    return df.select(F.to_json(F.struct(*body)).alias("value"))


def known_source(source: Column | str = "source") -> Column:
    """The source, or ``unknown`` where it is missing or empty: for counts, never for filters."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))
