"""Chunking: long texts split along sentences or words, at one or several scales."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import sentences, word_count, words

#: A last chunk of fewer than this share of the budget joins the one before.
TAIL = 0.25
#: Texts whose chunks Python holds at a time.
ROWS = 64


def _check(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("an overlap must be at least 0 and less than the chunk size")


def word_windows(text: Column | str, size: int, overlap: int) -> Column:
    """Chunks of ``size`` words that overlap by ``overlap``, joined by one blank; the last one holds what is left."""
    _check(size, overlap)
    step = size - overlap

    def cut(w: Column) -> Column:
        n = F.greatest(F.ceil((F.size(w) - F.lit(size)) / F.lit(step)).cast("int") + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))

    # The words are bound as an element of an array: a lambda that named the split would have it done for each chunk.
    return F.flatten(F.transform(F.array(words(text)), cut))


def fold_sentences(parts: list[str], size: int, overlap: int) -> list[str]:
    """Sentences filled into chunks of up to ``size`` words; the last sentences that fit into ``overlap`` words open the next one.

    A sentence is never split, and what an overlap adds isn't counted against the budget a second time.
    """
    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for sentence in parts:
        n = len(sentence.split())
        if held and total + n > size:
            chunks.append(" ".join(s for s, _ in held))
            carried: list[tuple[str, int]] = []
            room = overlap
            for s, m in reversed(held):
                if m > room:
                    break
                carried.append((s, m))
                room -= m
            held = carried[::-1]
            total = sum(m for _, m in held)
        held.append((sentence, n))
        total += n
    if held:
        rest = " ".join(s for s, _ in held)
        if chunks and total < TAIL * size:
            chunks[-1] += " " + rest
        else:
            chunks.append(rest)
    return chunks


def _sentence_chunks(size: int, overlap: int):
    @F.arrow_udf(ArrayType(StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # Text by text and in Arrow's own buffers: a batch of texts as Python's strings takes many times its bytes.
            done = [pa.array([fold_sentences(x.as_py(), size, overlap) if x.is_valid else None for x in batch[k : k + ROWS]], pa.list_(pa.string())) for k in range(0, len(batch), ROWS)]
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))

    return run


def with_chunks(df: DataFrame, size: int, overlap: int, text: str = "text", out: str = "chunks") -> DataFrame:
    """``df`` with an array of chunks. Texts within the budget are one chunk as they are; those of one sentence are cut by words.

    Python is given the sentences of the texts that need it, null for all others.
    """
    _check(size, overlap)
    counted = df.withColumn("__n", word_count(text)).withColumn("__s", sentences(text))
    long = F.coalesce(F.col("__n") > size, F.lit(False))
    several = counted.withColumn("__several", _sentence_chunks(size, overlap)(F.when(long & (F.size("__s") > 1), F.col("__s"))))
    chunks = F.when(~long, F.array(text)).when(F.size("__s") <= 1, word_windows(text, size, overlap)).otherwise(F.col("__several"))
    return several.withColumn(out, chunks).drop("__n", "__s", "__several")


def merge_metadata(metadata: Column | str, new: dict[str, Column]) -> Column:
    """Variant metadata with further keys, which replace those of the same name."""
    old = F.from_json(F.to_json(metadata), "map<string,variant>")
    kept = F.map_filter(F.coalesce(old, F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, _: ~k.isin(list(new)))
    more = F.create_map(*[x for k, v in new.items() for x in (F.lit(k), F.to_variant_object(F.struct(v.alias("v"))).alias("x"))])
    more = F.transform_values(more, lambda _, v: F.variant_get(v, "$.v", "variant"))
    return F.to_variant_object(F.map_concat(kept, more))


def _rows(chunked: DataFrame, infix: str, kind: str, extra: dict[str, Column], whole: dict[str, Column]) -> DataFrame:
    """A row a chunk. Entries of one chunk stay as they are, but for the columns ``whole``."""
    rows = chunked.select("*", F.size("chunks").alias("__total"), F.posexplode("chunks").alias("__at", "__chunk")).drop("chunks")
    cut, at, total = F.col("__total") > 1, F.col("__at"), F.col("__total")
    lineage = {"parent_id": F.col("id"), "chunk_index": at, "total_chunks": total}
    title = F.concat(F.col("title"), F.lit(f" ({kind}part "), (at + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))
    of_chunk = {
        "metadata": merge_metadata("metadata", {**lineage, **extra}),
        "title": F.when(F.coalesce(F.col("title"), F.lit("")) != "", title),
        "id": F.concat(F.col("id"), F.lit(f"__{infix}chunk_"), at.cast("string")),
        **{c: F.lit(None).cast(rows.schema[c].dataType) for c in ("content_hash", "embedding") if c in rows.columns},
    }
    columns = {c: F.when(cut, v).otherwise(whole.get(c, F.col(c))) for c, v in of_chunk.items()}
    return rows.withColumns({**{c: F.when(cut, v) for c, v in lineage.items()}, **columns, "text": F.col("__chunk")}).drop("__total", "__at", "__chunk")


def _emptied(df: DataFrame) -> DataFrame:
    for c in ("content_hash", "embedding"):
        if c in df.columns:
            df = df.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    return df


def chunk_entries(df: DataFrame, chunk_tokens: int = 500, overlap_tokens: int = 50) -> DataFrame:
    """Entries with long texts replaced by their chunks (``id__chunk_i``), others as they are.

    Adds parent_id, chunk_index and total_chunks, null for entries that were not cut; ``metadata`` of
    chunks holds them, too. Chunks have neither hash nor vector. Order: idx (if any), chunk_index.
    """
    return _rows(with_chunks(df, chunk_tokens, overlap_tokens), "", "", {}, {})


def multiscale_chunk_entries(df: DataFrame, scales: list[int], overlap_tokens: int = 50) -> DataFrame:
    """Entries at each scale; ``scale_pos`` (-1 for texts within the smallest one, which come once) and ``scale`` tell which.

    A text that one scale leaves whole is ``id__s{scale}`` without a parent; chunks are ``id__s{scale}_chunk_i``. Of short
    entries that share an id, the first (by idx, if there is one) stays. Order: scale_pos, idx, chunk_index.
    """
    least = min(scales)
    lineage = {"parent_id": F.lit(None).cast("string"), "chunk_index": F.lit(None).cast("int"), "total_chunks": F.lit(None).cast("int")}
    counted = df.withColumn("__n", F.coalesce(word_count("text"), F.lit(0)))
    order = Window.partitionBy("id").orderBy(*([F.col("idx")] if "idx" in df.columns else [F.col("text")]))
    out = counted.where(F.col("__n") <= least).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__n")
    out = out.withColumns({**lineage, "scale": F.lit(None).cast("int"), "scale_pos": F.lit(-1)})
    long = counted.where(F.col("__n") > least).drop("__n")
    for k, scale in enumerate(scales):
        chunked = with_chunks(long, scale, min(overlap_tokens, scale - 1)).withColumns({"scale": F.lit(scale), "scale_pos": F.lit(k)})
        whole = {"metadata": merge_metadata("metadata", {"scale": F.lit(scale)}), "id": F.concat("id", F.lit(f"__s{scale}"))}
        out = out.unionByName(_emptied(_rows(chunked, f"s{scale}_", f"s{scale} ", {"scale": F.lit(scale)}, whole)))
    return out
