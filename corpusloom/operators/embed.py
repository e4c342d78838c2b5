"""Embedding with a cache by content hash, and the providers that make vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clipped, content_hash

CACHE_SCHEMA = "content_hash string, dim int, embedding array<float>"

#: Texts -> vectors; called on executors, so it must be picklable. It may raise; batches are then halved.
Encode = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Model:
    name: str
    dim: int = 768
    backend: str = "sentence-transformers"
    batch: int = 64
    max_chars: int = 16_000
    encode: Encode | None = None


KNOWN_MODELS = {
    "Alibaba-NLP/gte-modernbert-base": Model("Alibaba-NLP/gte-modernbert-base", 768, "sentence-transformers", 64),
    "qwen3-embedding:8b": Model("qwen3-embedding:8b", 4096, "ollama", 16),
}


def model_of(name: str, **changes) -> Model:
    """A known model's settings, or the defaults for an unknown name; ``changes`` win."""
    return replace(KNOWN_MODELS.get(name, Model(name)), **changes)


@dataclass(frozen=True)
class HashingEncoder:
    """Vectors of hashed words, at length one: deterministic, for tests and as a baseline without a model."""

    dim: int = 64

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def encode_adaptively(encode: Encode, texts: list[str], batch: int) -> list[list[float] | None]:
    """Vectors of all texts; a failing batch is tried again, then halved, down to single texts, whose failure gives None."""
    out: list[list[float] | None] = []
    for at in range(0, len(texts), batch):
        part = texts[at : at + batch]
        for _ in range(2):
            try:
                out += [np.asarray(v, dtype=np.float32).tolist() for v in encode(part)]
                break
            except Exception as error:  # noqa: BLE001 - providers fail in their own ways
                failure = error
        else:
            if len(part) == 1:
                print(f"no vector for a text of {len(part[0])} characters: {failure}")
                out.append(None)
            else:
                half = (len(part) + 1) // 2
                out += encode_adaptively(encode, part[:half], half) + encode_adaptively(encode, part[half:], half)
    return out


def encode_texts(rows: DataFrame, model: Model) -> DataFrame:
    """(content_hash, text) -> (content_hash, embedding), clipped to the model's characters, in Arrow batches."""
    if model.encode is None:
        raise ValueError(f"model {model.name} has no encoder here")
    encode, batch_size = model.encode, model.batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):  # Python holds the texts and vectors of one call
                part = batch.slice(at, batch_size)
                made = encode_adaptively(encode, part.column("text").to_pylist(), batch_size)
                yield pa.RecordBatch.from_arrays([part.column("content_hash"), pa.array(made, pa.list_(pa.float32()))], ["content_hash", "embedding"])

    return rows.select("content_hash", clipped("text", model.max_chars).alias("text")).mapInArrow(run, "content_hash string, embedding array<float>")


def load_cache(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Vectors of the cache of that dimension; empty, where there is none. One vector a hash: the least, so that reads agree."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("dim") == dim).groupBy("content_hash", "dim").agg(F.min("embedding").alias("embedding"))


def save_cache(new: DataFrame, path: str, dim: int) -> None:
    """Appends vectors; those without one are left out, and so tried again by the next run."""
    new.where("embedding IS NOT NULL").select("content_hash", F.lit(dim).alias("dim"), "embedding").write.mode("append").parquet(path)


def compact_cache(spark: SparkSession, path: str, dim: int, out: str, files: int = 8) -> None:
    """Rewrites a cache of many small files as a few."""
    load_cache(spark, path, dim).coalesce(files).write.mode("overwrite").parquet(out)


def cache_hits(entries: DataFrame, cache: DataFrame) -> DataFrame:
    return entries.join(cache.select("content_hash"), "content_hash", "left_semi")


def cache_misses(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """One row a text that the cache lacks: texts that repeat are embedded once."""
    return entries.select("content_hash", "text").join(cache.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min("text").alias("text"))


def embed_entries(entries: DataFrame, model: Model, cache_path: str | None = None, force: bool = False) -> DataFrame:
    """Entries with content_hash and embedding. New vectors are appended to the cache before they are joined,
    so that a run that breaks off has lost nothing that was written."""
    spark = entries.sparkSession
    hashed = entries.drop("embedding", "content_hash").withColumn("content_hash", content_hash())
    cache = spark.createDataFrame([], CACHE_SCHEMA) if force or not cache_path else load_cache(spark, cache_path, model.dim)
    made = encode_texts(cache_misses(hashed, cache), model)
    if cache_path:
        save_cache(made, cache_path, model.dim)
        known = load_cache(spark, cache_path, model.dim).select("content_hash", "embedding")
    else:
        known = made
    return hashed.join(known, "content_hash", "left")


def truncated_count(entries: DataFrame, max_chars: int = 16_000) -> DataFrame:
    return entries.agg(F.count_if(F.char_length("text") > max_chars).alias("truncated"))


