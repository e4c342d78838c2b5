"""Connected components in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _rooted(parents: DataFrame) -> DataFrame:
    """(id, parent) of a forest, with each parent replaced by its root: every step doubles the reach of all."""
    while True:
        up = parents.select(F.col("id").alias("via"), F.col("parent").alias("further"))
        new = materialize(parents.join(up, F.col("parent") == F.col("via"), "left").select("id", F.coalesce("further", "parent").alias("parent"), (F.coalesce("further", "parent") != F.col("parent")).alias("moved")), "cc-parents")
        moved = new.where("moved").limit(1).count()
        discard(parents)
        parents = new.drop("moved")
        if not moved:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the undirected edges (a, b); component is the least id reachable.

    Every round points each id at the least among itself and its neighbours, follows the pointers to their roots, and
    contracts the edges to roots. At least half of the ids that have an edge left are no roots, so the rounds are
    at most the logarithm of their number; where ids are densely linked, as near copies are, one round leaves nothing.
    Tables are written between steps, which keeps the lineage short. Rows with a null end are no edges; self-loops
    keep lonely ids.
    """
    left = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while True:
        # Only ends that are greater than a neighbour move; the other ones are their own parents.
        near = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent")).unionByName(left.select(F.col("a").alias("id"), F.col("a").alias("parent")).distinct())
        roots = _rooted(materialize(near.groupBy("id").agg(F.min("parent").alias("parent")), "cc-parents"))
        if labels is None:
            labels = roots.select("id", F.col("parent").alias("component"))
        else:
            step = roots.select(F.col("id").alias("component"), "parent")
            labels = materialize(labels.join(step, "component", "left").select("id", F.coalesce("parent", "component").alias("component")), "cc-labels")
        of = lambda x: roots.select(F.col("id").alias(x), F.col("parent").alias(f"root_{x}"))
        contracted = left.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
        new = materialize(contracted, "cc-edges")
        discard(left)
        left = new
        if not left.limit(1).count():
            return labels
