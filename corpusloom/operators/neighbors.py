"""Spreading activation over shared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(entries: DataFrame, keys: Column) -> DataFrame:
    """(key, idx) for an array of keys of each entry; null keys are none."""
    return entries.select("idx", F.explode(keys).alias("key")).where("key IS NOT NULL").distinct()


def expand(graph: DataFrame, anchors: DataFrame, valid: DataFrame | None = None, max_neighbors: int = 30) -> DataFrame:
    """(idx, first_anchor): entries that share a key with an anchor, in the order in which anchors reveal them.

    ``anchors``: (idx, pos). Anchors are taken in turn until ``max_neighbors`` are found; the one that reaches
    the number still adds all of its own. Anchors are no neighbours; ``valid`` (idx) restricts the rest.
    """
    mine = graph.join(F.broadcast(anchors), "idx").select("key", "pos")  # a few anchors' keys
    reached = graph.join(F.broadcast(mine), "key").join(F.broadcast(anchors.select("idx")), "idx", "left_anti")
    if valid is not None:
        reached = reached.join(valid.select("idx"), "idx", "left_semi")
    first = reached.groupBy("idx").agg(F.min("pos").alias("first_anchor"))
    per_anchor = first.groupBy("first_anchor").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first_anchor").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = per_anchor.select("first_anchor", before.alias("before")).where(F.col("before") < max_neighbors)
    return first.join(F.broadcast(open_.select("first_anchor")), "first_anchor").select("idx", "first_anchor")


def spread_scores(results: DataFrame, graph: DataFrame, valid: DataFrame | None = None, boost: float = 0.3, anchors: int = 10, max_neighbors: int = 30) -> DataFrame:
    """Results (idx, score, pos) with the scores of the neighbours of the first ``anchors`` drawn towards their mean, flagged
    ``_expanded`` and ordered anew by score. No rows are added, and a mean may lower a score."""
    top = results.orderBy("pos").limit(anchors).select("idx", "pos", "score")
    near = expand(graph, top.select("idx", "pos"), valid, max_neighbors).select("idx", F.lit(True).alias("__near"))
    mean = top.agg(F.avg("score").alias("__mean"))
    drawn = results.join(near, "idx", "left").crossJoin(F.broadcast(mean))
    score = F.when(F.col("__near"), F.col("score") * (1 - boost) + F.col("__mean") * boost).otherwise(F.col("score"))
    out = drawn.withColumn("score", score).withColumn("_expanded", F.coalesce("__near", F.lit(False))).drop("__near", "__mean")
    return out.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "pos")) - 1)
