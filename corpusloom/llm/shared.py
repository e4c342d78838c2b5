"""What the operators of this package have in common."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"

#: Rows up to which a set of ids is broadcast; beyond it, the join shuffles.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the session has it, else the context's own.

    Where neither is set, a ``local`` master (tests, one machine) gets a temporary folder; a cluster is an error, as a
    folder of one machine would be lost on all others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom_"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage, survives lost executors, and lets later steps prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a materialized table that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join of ``df`` with a materialized set of ids.

    The ids are counted first (a Parquet footer read): up to ``most`` of them are
    broadcast, so that wide rows of ``df`` stay where they are; more are joined by shuffle.
    """
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def one_text_an_id(source: DataFrame, texts: DataFrame) -> DataFrame:
    """``source`` (id, text) with one row for each id that ``texts`` has: rows that repeat one are the least of their texts.

    Where no id repeats, ``source`` itself.
    """
    repeated = materialize(texts.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if repeated.limit(1).count() == 0:
        return source
    least = keep_ids(source, repeated, "id").groupBy("id").agg(F.min("text").alias("text"))
    return keep_ids(source, repeated, "id", "left_anti").unionByName(least)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    Pure ASCII texts take the fast built-in; for them both forms agree.
    """
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
