"""Packing entries into batches of bounded length, and what is said of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import packed_entry
from ..schema import known_source

CHARS_PER_TOKEN = 3
INPUT_TOKENS = 948_576
MAX_CHARS = INPUT_TOKENS * CHARS_PER_TOKEN


def assign_batches(lengths: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(idx, batch_id, oversize) from (idx, length): entries in order of idx go into a batch while they fit.

    An entry longer than the budget closes the batch before it and is one of its own. The fold is sequential by nature; it
    sees two numbers an entry, in Arrow batches of one sorted partition, and holds none of them. The lengths are taken where
    the texts are and shuffled to the one task: without a shuffle, it would read all texts itself.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch_id, used, holds = 0, 0, False
        for rows in batches:
            ids, over = [], []
            for n in rows["length"]:
                big = n > max_chars
                if holds and (big or used + n > max_chars):
                    batch_id, used, holds = batch_id + 1, 0, False
                ids.append(batch_id)
                over.append(bool(big))
                if big:
                    batch_id += 1
                else:
                    used, holds = used + n, True
            yield pd.DataFrame({"idx": rows["idx"], "batch_id": ids, "oversize": over})

    return lengths.select("idx", "length").repartition(1).sortWithinPartitions("idx").mapInPandas(fold, "idx long, batch_id long, oversize boolean")


def pack_batches(entries: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(batch_id, entries, text, est_tokens): the formatted entries of each batch in order; an oversize one is cut to the budget."""
    formatted = entries.select("idx", packed_entry().alias("body")).withColumn("length", F.char_length("body").cast("long"))
    placed = formatted.join(assign_batches(formatted, max_chars), "idx")
    rows = placed.withColumn("body", F.when(F.col("oversize"), F.substring("body", 1, max_chars)).otherwise(F.col("body")))
    # A batch is no longer than the budget.
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "body"))), lambda e: e["body"]), "").alias("text")
    ).withColumn("est_tokens", F.floor(F.char_length("text") / CHARS_PER_TOKEN))


def corpus_stats(entries: DataFrame) -> DataFrame:
    """Entries, characters, and tokens at four characters each."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).withColumn("tokens", F.floor(F.col("chars") / 4))


def manifest(entries: DataFrame, titles: int = 5) -> DataFrame:
    """(source, entries, titles): most entries first, then first seen; the first titles (or ids), ``, ...`` if there are more.

    Titles are ranked before they are gathered, so no list outgrows their number.
    """
    named = entries.select("idx", known_source().alias("source"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("id")).alias("name"))
    counts = named.groupBy("source").agg(F.count("*").alias("entries"), F.min("idx").alias("first"))
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("idx"))).where(F.col("r") <= titles)
    lists = ranked.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda t: t["name"]), ", ").alias("listed"))
    out = counts.join(lists, "source").withColumn("titles", F.when(F.col("entries") > titles, F.concat("listed", F.lit(", ..."))).otherwise(F.col("listed")))
    return out.orderBy(F.desc("entries"), "first").select("source", "entries", "titles")


def manifest_text(entries: DataFrame) -> str:
    return "\n".join(f"- {r.source} ({r.entries} entries): {r.titles}" for r in manifest(entries).collect())
