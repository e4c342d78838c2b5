"""Search requests, and the plan that answers one."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.dates import check_half_lives, freshness
from ..operators import bm25
from ..operators.merge import first_per_key

RRF_K = 60
BM25_LIMIT = 200
RERANK_POOL = 3

PostProcessor = Callable[[str, DataFrame, DataFrame], DataFrame]


def expand_sources(sources: Iterable[str], groups: dict[str, Iterable[str]]) -> set[str]:
    """Names of groups replaced by their members, one level deep; unknown names stay."""
    return {m for s in sources for m in (groups[s] if s in groups else [s])}


@dataclass(frozen=True)
class SearchRequest:
    """What to search for. ``vector`` is the encoded query; ``entry_filter`` and ``dedup_key`` are column expressions
    over the entries (Python callables can be wrapped as UDFs by the caller)."""

    query: str
    vector: tuple[float, ...]
    top_k: int = 20
    sources: frozenset[str] = frozenset()
    entry_filter: Column | None = None
    min_similarity: float = 0.0
    since: datetime | None = None
    hybrid: bool = False
    freshness_weight: float = 0.0
    half_lives: dict[str, float | None] = field(default_factory=dict)
    as_of: datetime = field(default_factory=datetime.now)
    sort_by: str = "relevance"
    provenance: bool = False
    dedup_key: Column | None = None
    deduplicate: bool = True
    post_processors: tuple[PostProcessor, ...] = ()
    reranker: Callable[[str, DataFrame], DataFrame] | None = None


def default_dedup_key() -> Column:
    """The parent of a chunk; other entries have none. An empty string is a key."""
    return F.variant_get("metadata", "$.parent_id", "string")


def valid_entries(entries: DataFrame, request: SearchRequest) -> DataFrame:
    """Entries with ``sim`` that pass all filters. All but the least similarity come before the products are computed."""
    rows = entries
    if request.sources:
        rows = rows.where(F.col("source").isin(sorted(request.sources)))
    if request.entry_filter is not None:
        rows = rows.where(request.entry_filter)
    if request.since is not None:
        rows = rows.where(F.col("date_parsed") >= F.lit(request.since.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"))
    rows = rows.withColumn("sim", vectors.dot("embedding", vectors.literal(request.vector)))
    return rows.where(F.col("sim") >= request.min_similarity) if request.min_similarity > 0 else rows


def dense_ranks(valid: DataFrame) -> DataFrame:
    """(idx, dense_rank) from 0 by falling similarity, ties to the smaller idx, without a window over all rows.

    Rows are laid out by range of rank, numbered within their partition, and shifted by the sizes of the
    partitions before: each task sees a part only.
    """
    key = F.struct((-F.col("sim")).alias("a"), "idx")
    laid = valid.select("idx", "sim").repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    placed = laid.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("sim"), "idx")))
    sizes = laid.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))  # one row a partition
    return placed.join(starts, "__part").select("idx", (F.col("__n") + F.col("__before") - 1).cast("long").alias("dense_rank"))


def scored(entries: DataFrame, request: SearchRequest, index: bm25.TextIndex | None = None) -> DataFrame:
    """Valid entries with sim, score and what they come from."""
    check_half_lives(request.half_lives)
    rows = valid_entries(entries, request)
    if request.hybrid or request.provenance:
        rows = rows.join(dense_ranks(rows), "idx")
    base = F.col("sim")
    if request.hybrid:
        if index is None:
            raise ValueError("a hybrid search needs a text index")
        hits = bm25.search(index, request.query, BM25_LIMIT)
        # At most 200 rows: taken over the whole corpus first, numbered among the valid ones after.
        hits = hits.join(rows.select("idx"), "idx", "left_semi")
        hits = hits.select("idx", (F.row_number().over(Window.orderBy(F.desc("bm25"), "idx")) - 1).cast("long").alias("bm25_rank"))
        rows = rows.join(F.broadcast(hits), "idx", "left")
        rows = rows.withColumn("rrf_dense", 1 / (RRF_K + F.col("dense_rank"))).withColumn("rrf_bm25", F.coalesce(1 / (RRF_K + F.col("bm25_rank")), F.lit(0.0)))
        base = F.col("rrf_dense") + F.col("rrf_bm25")
    else:
        rows = rows.withColumns({"bm25_rank": F.lit(None).cast("long"), "rrf_dense": F.lit(None).cast("double"), "rrf_bm25": F.lit(None).cast("double")})
    w = request.freshness_weight
    fresh = freshness(request.as_of, request.half_lives) if w > 0 else F.lit(1.0)
    return rows.withColumn("fresh", fresh).withColumn("score", base * (1 - w + w * F.col("fresh")) if w > 0 else base)


def ordering(request: SearchRequest) -> list[Column]:
    if request.sort_by == "date":
        return [F.desc_nulls_last("date_parsed"), F.desc("score"), F.col("idx")]
    return [F.desc("score"), F.col("idx")]


def provenance(request: SearchRequest, reranked: bool) -> Column:
    hybrid = [F.col("bm25_rank"), F.round("rrf_dense", 6).alias("rrf_dense"), F.round("rrf_bm25", 6).alias("rrf_bm25"), F.round(F.col("rrf_dense") + F.col("rrf_bm25"), 6).alias("rrf_total")]
    parts = [F.round("sim", 4).alias("dense_sim"), F.col("dense_rank"), *(hybrid if request.hybrid else [])]
    if request.freshness_weight > 0:
        parts.append(F.round("fresh", 4).alias("freshness_factor"))
    if reranked:
        parts += [F.col("pre_rank"), F.col("post_rank"), F.round("rerank_score", 4).alias("rerank_score"), (F.col("pre_rank") - F.col("post_rank")).alias("rank_delta")]
    return F.struct(*parts)


def search(entries: DataFrame, request: SearchRequest, index: bm25.TextIndex | None = None) -> DataFrame:
    """The results in order of ``pos``: id, source, title, date, text (300 characters), similarity, metadata, and on request
    provenance and rerank_score. ``entries`` needs idx, embedding and date_parsed beside the fields of an entry."""
    rows = scored(entries, request, index)
    pool = request.top_k * (RERANK_POOL if request.reranker else 1)
    order = ordering(request)
    if request.post_processors:
        # A processor may reorder at will, so positions are made for it; it sees and returns them as ``pos``.
        rows = rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)
        valid = rows.select("idx")
        for process in request.post_processors:
            rows = process(request.query, rows, valid)
        order = [F.col("pos")]
    if request.deduplicate:
        rows = first_per_key(rows, request.dedup_key if request.dedup_key is not None else default_dedup_key(), order, F.col("idx"))
    rows = rows.orderBy(*order).limit(pool)
    rows = rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)  # over the pool only
    if request.reranker:
        rows = request.reranker(request.query, rows.withColumnRenamed("pos", "pre_rank")).orderBy(F.desc("rerank_score"), "pre_rank").limit(request.top_k)
        rows = rows.withColumn("post_rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "pre_rank")) - 1).withColumn("pos", F.col("post_rank"))
    columns = ["pos", "id", "source", "title", "date", F.substring("text", 1, 300).alias("text"), F.col("sim").alias("similarity"), "metadata"]
    if request.provenance:
        columns.append(provenance(request, request.reranker is not None).alias("provenance"))
    if request.reranker:
        columns.append("rerank_score")
    return rows.select(*columns)
