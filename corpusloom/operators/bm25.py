"""BM25 over an inverted index, with phrases, boolean queries and weighted columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fts

COLUMNS = ("title", "text", "source")
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


@dataclass
class TextIndex:
    """postings: (term, idx, col, positions, len); stats: one row (n, total). ``analyzer`` names how terms are made."""

    postings: DataFrame
    stats: DataFrame
    analyzer: str = "porter"

    def analyze(self, text: str) -> list[str]:
        return (fts.stemmed if self.analyzer == "porter" else fts.plain)(text)

    def write(self, path: str) -> None:
        """Postings ordered by term, so that a query reads the few row groups that may hold its terms."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "idx").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats-{self.analyzer}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, analyzer: str = "porter") -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats-{analyzer}"), analyzer)


def build(entries: DataFrame, analyzer: str = "porter") -> TextIndex:
    """The index of title, text and source by idx. ``plain`` (ASCII words) stays in the JVM; ``porter`` stems in Python."""
    if analyzer == "plain":
        terms = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
        listed = entries.select("idx", *[terms(c).alias(c) for c in COLUMNS]).withColumn("len", F.size("title") + F.size("text") + F.size("source"))
        parts = [listed.select("idx", "len", F.lit(c).alias("col"), F.posexplode(c).alias("pos", "term")) for c in COLUMNS]
        postings = reduce(DataFrame.unionByName, parts).groupBy("term", "idx", "col", "len").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        stats = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
        return TextIndex(postings, stats, analyzer)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for idx, *texts in batch[["idx", *COLUMNS]].itertuples(index=False):
                found = [fts.stemmed(t) if isinstance(t, str) else [] for t in texts]
                length = sum(map(len, found))
                for col, tokens in zip(COLUMNS, found, strict=True):
                    places: dict[str, list[int]] = {}
                    for p, t in enumerate(tokens):
                        places.setdefault(t, []).append(p)
                    rows += [(t, idx, col, length, p) for t, p in places.items()]
                rows.append(("", idx, "", length, []))  # the length of every entry, also of those without words
            yield pd.DataFrame(rows, columns=["term", "idx", "col", "len", "positions"])

    everything = entries.select("idx", *COLUMNS).mapInPandas(split, "term string, idx long, col string, len int, positions array<int>")
    lengths = everything.where("col = ''")
    return TextIndex(everything.where("col <> ''"), lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")), analyzer)


def _occurrences(phrase: fts.Phrase, column: str) -> Column:
    """How often the terms of a phrase follow each other in a column."""
    places = [F.coalesce(F.try_element_at(F.col("places"), F.lit(f"{column}\x00{t}")), F.array().cast("array<int>")) for t in phrase.terms]
    if len(places) == 1:
        return F.size(places[0])
    follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(x, p + k + 1) for k, x in enumerate(places[1:])])
    return F.size(F.filter(places[0], follows))


def search(index: TextIndex, query: str, limit: int | None = 200, weights: tuple[float, float, float] = (10.0, 1.0, 0.0)) -> DataFrame:
    """(idx, bm25): the best rows for a query, ties to the smaller idx; none for a query without terms or with wrong syntax.

    An idf of 0 or less counts as 1e-6; a phrase is rare or common by the rows that hold it in any column; it only
    adds to rows in which its branch of the query matches.
    """
    spark = index.postings.sparkSession
    none = spark.createDataFrame([], "idx long, bm25 double")
    try:
        tree = fts.parse(fts.safe_query(query), index.analyze)
    except fts.QuerySyntaxError:
        return none
    if tree in (fts.EMPTY, fts.NONE):
        return none
    found = list(dict.fromkeys(fts.phrases(tree)))
    terms = sorted({t for p in found for t in p.terms})
    rows = index.postings.where(F.col("term").isin(terms)).groupBy("idx").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat("col", F.lit("\x00"), "term"), "positions"))).alias("places"), F.first("len").alias("len")
    )  # at most terms x columns a row
    counts = {(k, c): _occurrences(p, c) for k, p in enumerate(found) for c in COLUMNS}
    rows = rows.select("idx", "len", *[x.alias(f"n{k}_{c}") for (k, c), x in counts.items()])
    held = lambda k: reduce(lambda a, b: a | b, [F.col(f"n{k}_{c}") > 0 for c in COLUMNS])
    rows = rows.select("idx", "len", *[held(k).alias(f"m{k}") for k in range(len(found))], *[reduce(lambda a, b: a + b, [F.col(f"n{k}_{c}") * F.lit(w) for c, w in zip(COLUMNS, weights, strict=True)]).alias(f"tf{k}") for k in range(len(found))])
    df = rows.agg(*[F.count_if(f"m{k}").alias(f"df{k}") for k in range(len(found))])
    rows = rows.crossJoin(F.broadcast(df.crossJoin(index.stats)))  # one row of statistics

    def score(k: int) -> Column:
        idf = F.ln((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        tf = F.col(f"tf{k}")
        return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("n"))))

    def walk(node) -> tuple[Column, Column]:
        if isinstance(node, fts.Phrase):
            k = found.index(node)
            return F.col(f"m{k}"), F.when(F.col(f"m{k}"), score(k)).otherwise(0.0)
        parts = [walk(p) for p in node.parts]
        if node.kind == "not":
            match, value = parts[0][0] & ~parts[1][0], parts[0][1]
        else:
            match = reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), [m for m, _ in parts])
            value = reduce(lambda a, b: a + b, [v for _, v in parts])
        return match, F.when(match, value).otherwise(0.0)

    match, value = walk(tree)
    ranked = rows.where(match).select("idx", value.alias("bm25"))
    return ranked.orderBy(F.desc("bm25"), "idx").limit(limit) if limit else ranked
