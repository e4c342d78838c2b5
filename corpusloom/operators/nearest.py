"""Exact nearest rows of many queries, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

#: Rows and queries of a block, about; a block's products are made for so many queries at a time.
BLOCK, SLICE = 4096, 256
#: Products that are summed again at a time, but for those of a single query.
AGAIN = 65_536


def best_of_block(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, sim) of each query's k best rows by falling sim, then id, with sums from left to right.

    Matrix products add up in another order, so they only choose: what lies within their error of the k-th is summed again.
    """
    rows, queries = rows.astype(np.float64), queries.astype(np.float64)
    found, k = [], min(k, len(ids))
    error = 4 * (rows.shape[1] + 2) * np.finfo(np.float64).eps * np.sqrt((rows**2).sum(axis=1).max()) * np.sqrt((queries**2).sum(axis=1)) + 1e-300
    for at in range(0, len(queries), SLICE):
        near = queries[at : at + SLICE] @ rows.T
        least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] - error[at : at + SLICE]
        q, r = np.nonzero(near >= least[:, None])
        ends = np.searchsorted(q, np.arange(len(near)), side="right")
        lo = 0
        while lo < len(q):
            fits = np.searchsorted(ends, lo + AGAIN, side="right")  # whole queries, one at least
            hi = max(ends[q[lo]], ends[fits - 1] if fits else 0)
            part, row = q[lo:hi], r[lo:hi]
            sims = np.cumsum(queries[at + part] * rows[row], axis=1)[:, -1] + 0.0
            order = np.lexsort((ids[row], -sims, part))
            part, row, sims = part[order], row[order], sims[order]
            first = np.searchsorted(part, part, side="left")
            keep = np.arange(len(part)) - first < k
            found.append((at + part[keep], ids[row[keep]], sims[keep]))
            lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _products(rows: DataFrame, asked: DataFrame, parts: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides laid out so that each part of the rows meets each block of the queries once."""
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.select("vec_id", "embedding", place("vec_id", parts).alias("part"), spread(blocks).alias("block")), asked.select("query_id", "q", place("query_id", blocks).alias("block"), spread(parts).alias("part"))


def nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, sim, n): for each query of (query_id, q) the k best of all rows (vec_id, embedding), n from 1.

    Vectors of the usual length and of finite numbers go through numpy in blocks; others meet all by column expressions.
    """

    def usual(v: str, dim: int):
        return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.lit(dim > 0)

    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    dim = seen.dim or 0
    odd = rows.where(~usual("embedding", dim)).count()
    those = asked.agg(F.count("*").alias("n"), F.count_if(~usual("q", dim)).alias("odd")).first()

    def best(group_rows: pd.DataFrame, group_asked: pd.DataFrame) -> pd.DataFrame:
        if not len(group_rows) or not len(group_asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "sim": []})
        ids = group_asked["query_id"].to_numpy()
        q, r, sims = best_of_block(group_rows["vec_id"].to_numpy(), np.stack(group_rows["embedding"].to_numpy()), np.stack(group_asked["q"].to_numpy()), k)
        return pd.DataFrame({"query_id": ids[q], "vec_id": r, "sim": sims})

    parts, blocks = -(-seen.n // BLOCK) or 1, -(-those.n // BLOCK) or 1
    here, there = _products(rows.where(usual("embedding", dim)), asked.where(usual("q", dim)), parts, blocks)
    near = here.groupBy("part", "block").cogroup(there.groupBy("part", "block")).applyInPandas(best, "query_id long, vec_id long, sim double")
    others = []
    if odd:
        others.append((rows.where(~usual("embedding", dim)), asked))
    if those.odd:
        others.append((rows.where(usual("embedding", dim)), asked.where(~usual("q", dim))))
    for some, of in others:
        here, there = _products(some, of, parts, blocks)
        near = near.unionByName(here.join(there, ["part", "block"]).select("query_id", "vec_id", vectors.dot("embedding", "q").alias("sim")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return near.withColumn("n", rank).where(F.col("n") <= k)
