"""Reading and writing entries: JSON lines, indices in Parquet, and single-file JSON indices."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..schema import FILE_SCHEMA, as_entries, as_json, is_valid, known_source
from ..scratch import scratch

DEFAULT_DIM = 768
#: Ends the first line of a single-file index with an entry a line.
ENTRIES = ',"entries":['


def with_positions(df: DataFrame, column: str = "idx") -> DataFrame:
    """Rows numbered from 0 in the order in which they are read. Numbers are counted by partition, so no row moves.

    The rows are written with their partition, and the sizes are counted of what was written: a plan that is run twice may be
    cut differently (executors come and go, shuffles are coalesced by their size), and rows would be lost or share a number.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "positions")
    numbered = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    numbered.write.parquet(path)
    numbered = spark.read.schema(numbered.schema).parquet(path)
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", "__first", before.alias("__before")))  # one row a partition
    return numbered.join(starts, "__part").select(*[F.col(f"`{f.name}`") for f in df.schema], (F.col("__at") - F.col("__first") + F.col("__before")).alias(column))


def read_jsonl(spark: SparkSession, path: str | list[str], warn: bool = False) -> DataFrame:
    """Valid entries of JSON lines, in order (``idx``). Blank lines, lines that aren't JSON objects and rows without id
    or text are left out; ``warn`` counts the latter two (an extra pass)."""
    schema = T.StructType([*FILE_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if warn and (bad := raw.select("id", "text", "_corrupt").where(~is_valid() | F.col("_corrupt").isNotNull()).count()):
        warnings.warn(f"{bad} lines of {path} are not valid entries", stacklevel=2)
    return with_positions(as_entries(raw.where(F.col("_corrupt").isNull() & is_valid())))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes entries as JSON lines without null fields, in order of ``idx`` if there is one; returns how many."""
    seen = F.count(F.lit(1)).alias("n")
    from pyspark.sql import Observation

    rows = Observation("rows")
    ordered = df.orderBy("idx") if "idx" in df.columns else df
    as_json(ordered.observe(rows, seen)).write.mode(mode).text(path)
    return int(rows.get["n"])


@dataclass
class Metadata:
    """What an index says of itself; caller's keys come first, counts are always those of the rows."""

    values: dict = field(default_factory=dict)

    def with_counts(self, total: int, sources: dict[str, int], dim: int) -> dict:
        out = {"generated_at": datetime.now(UTC).isoformat(), "embedding_model": None} | self.values
        return out | {"total_entries": total, "sources": sources, "embedding_dim": dim or self.values.get("embedding_dim") or 0}


def source_counts(df: DataFrame) -> DataFrame:
    """(source, entries): missing and empty sources as ``unknown``."""
    return df.groupBy(known_source().alias("source")).agg(F.count("*").alias("entries"))


def _summary(df: DataFrame) -> tuple[int, dict[str, int], int]:
    per_source = df.groupBy(known_source().alias("s")).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).collect()
    dims = [r.dim for r in per_source if r.dim and r.dim > 0]
    return sum(r.n for r in per_source), {r.s: r.n for r in sorted(per_source, key=lambda r: r.s)}, max(dims, default=0)


def write_index(df: DataFrame, path: str, metadata: dict | None = None) -> dict:
    """Entries and vectors as Parquet, one folder a source (so that reading some sources prunes the rest), beside one
    row of metadata. Variant metadata is kept as JSON text. Returns the metadata."""
    rows = as_entries(df)
    if "idx" not in rows.columns:
        rows = with_positions(rows)
    spark = df.sparkSession
    stored = rows.withColumn("metadata", F.to_json("metadata")).withColumn("source_part", known_source())
    stored.write.mode("overwrite").partitionBy("source_part").parquet(f"{path}/entries")
    back = spark.read.schema(T.StructType([*stored.schema.fields])).parquet(f"{path}/entries")
    values = Metadata(metadata or {}).with_counts(*_summary(back))
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return values


def read_metadata(spark: SparkSession, path: str) -> dict:
    if path.endswith(".json"):
        if (head := _head(spark, path)) is not None:
            return head
        row = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path).select(F.to_json(F.variant_get("v", "$.metadata", "variant")).alias("m")).first()
        return json.loads(row.m) if row and row.m else {}
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def read_index(spark: SparkSession, path: str, sources: set[str] | list[str] | None = None) -> DataFrame:
    """An index's entries. ``sources`` restricts them by the raw source; an empty set gives no rows, None gives all."""
    rows = spark.read.parquet(f"{path}/entries").withColumn("metadata", F.parse_json("metadata"))
    if sources is not None:
        names = sorted(sources)
        # The partition column prunes folders; the raw column keeps a source named "unknown" apart from missing ones.
        rows = rows.where(F.col("source_part").isin([s or "unknown" for s in names]) & F.col("source").isin(names)) if names else rows.where(F.lit(False))
    return rows.drop("source_part")


def _head(spark: SparkSession, path: str) -> dict | None:
    """The metadata of a single JSON file with an entry a line, as ``write_json_index`` lays it out; None of any other."""
    row = spark.read.text(path).first()
    if not row or not row.value.startswith('{"metadata":') or not row.value.endswith(ENTRIES):
        return None
    try:
        return json.loads(row.value + "]}")["metadata"]
    except ValueError:
        return None


def read_json_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a single JSON file ``{metadata, entries: [...]}``, with their places in it. Files with an entry a line are
    read in parts; any other is one row of one task."""
    if _head(spark, path) is not None:
        lines = spark.read.text(path).where(F.col("value").startswith("{") & ~F.col("value").endswith(ENTRIES) | F.col("value").startswith(",{"))
        return as_entries(with_positions(lines.select(F.from_json(F.ltrim(F.col("value"), F.lit(",")), FILE_SCHEMA).alias("e")).select("e.*")))
    schema = T.StructType([T.StructField("entries", T.ArrayType(FILE_SCHEMA))])
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return as_entries(whole.select(F.posexplode("entries").alias("idx", "e")).select(F.col("idx").cast("long").alias("idx"), "e.*"))


def write_json_index(df: DataFrame, path: str, metadata: dict | None = None) -> dict:
    """One JSON file of the whole index, an entry a line: one task sorts the entries (on disk, if need be) and streams them."""
    rows = as_entries(df)
    values = Metadata(metadata or {}).with_counts(*_summary(rows))
    at = F.col("idx") if "idx" in rows.columns else F.monotonically_increasing_id()
    bodies = rows.select(at.alias("at"), F.to_json(F.struct(*[F.col(c) for c in FILE_SCHEMA.names])).alias("j")).repartition(1).sortWithinPartitions("at", "j")
    n, head = values["total_entries"], '{"metadata":' + json.dumps(values) + ENTRIES
    if n:
        placed = bodies.withColumn("n", F.monotonically_increasing_id())  # of the one partition: 0, 1, 2 ...
        before = F.when(F.col("n") == 0, F.lit(head + "\n")).otherwise(F.lit(","))
        text = placed.select(F.concat(before, "j", F.when(F.col("n") == n - 1, F.lit("\n]}")).otherwise(F.lit(""))).alias("value"))
    else:
        text = df.sparkSession.createDataFrame([(head + "\n]}",)], "value string").coalesce(1)
    text.write.mode("overwrite").text(path)
    return values


def json_to_split(spark: SparkSession, path: str, out: str) -> dict:
    """Entries without a vector get a zero vector of the index's dimension."""
    metadata = read_metadata(spark, path)
    dim = int(metadata.get("embedding_dim") or DEFAULT_DIM)
    rows = read_json_index(spark, path).withColumn("embedding", F.coalesce("embedding", vectors.zeros(dim)))
    return write_index(rows, out, metadata)


def split_to_json(spark: SparkSession, path: str, out: str) -> dict:
    return write_json_index(read_index(spark, path), out, read_metadata(spark, path))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A split index (a folder), JSON lines, or a single JSON file."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path)
    return read_json_index(spark, path) if path.endswith(".json") else read_index(spark, path)


def check_staleness(spark: SparkSession, index_path: str, source_dir: str, pattern: str = "*_parsed.json") -> list[str]:
    """Names of the files of a folder (not of its subfolders) that are newer than the index; none without an index."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.Path(source_dir).getFileSystem(conf)
    marks = [p for p in (f"{index_path}/metadata", index_path) if files.exists(jvm.org.apache.hadoop.fs.Path(p))]
    if not marks:
        return []
    built = files.getFileStatus(jvm.org.apache.hadoop.fs.Path(marks[0])).getModificationTime()
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{source_dir}/{pattern}")) or []
    return sorted(f.getPath().getName() for f in found if f.isFile() and f.getModificationTime() > built)


def disk_size(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of the parts of an index."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return parts.groupBy(F.element_at(F.split("path", "/"), -2).alias("name")).agg(F.sum("length").alias("bytes"))
