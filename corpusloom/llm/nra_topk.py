"""Exact top-k inner products by no-random-access aggregation.

Every dimension has a list of the candidates sorted by their value in it. For a query, a list is read from the end
that its weight favours, entry by entry from the first, in growing steps. A candidate that was seen has a lower bound (what was
seen, plus the least that each list in which it wasn't can add) and an upper bound (what was seen, plus the value at which each
such list stands); one that no list has shown yet is bounded by the values at which all lists stand. Once the k-th lower
bound is above the upper bounds of all others, the best k are known; reading goes on until their scores are known, too: every
list has shown them, or can only add one value. No candidate's values are ever looked up. Values are integers, so all bounds are exact.

Candidates and queries are cut into blocks that meet pairwise in tasks of bounded size; each task keeps its k
best a query, and the blocks' results are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

SCHEMA = "query_id long, vec_id long, score long"
#: Sums of products beyond this are not exact in the floating-point numbers that hold them.
EXACT = float(1 << 53)


@dataclass
class Read:
    """How far the lists were read for a query: entries of each list until the best k were known, and until their scores were."""

    known: int
    resolved: int


class Lists:
    """The sorted lists of a block of candidates: one row a dimension of who (places in order of id) and values, ascending."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order].T.astype(np.float64)
        self.largest = float(np.abs(values).max(initial=0))
        self.who = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.who, axis=1)

    def top(self, queries: np.ndarray, query_ids: np.ndarray, k: int, first: int = 16) -> list[tuple[np.ndarray, np.ndarray, Read]]:
        """For each query (ids, scores, depths read) of the k best candidates but the query itself, ties to the smaller id.

        Which entry comes next depends on the sign of a weight alone, so the queries read together: what a step
        shows adds to their sums by two matrix products, of the positive weights with entries from the upper ends of the lists and of
        the negative ones with entries from the lower ends. A query that is done reads no further.
        Raises ValueError where scores could pass 2**53, beyond which they would not be exact.
        """
        queries = queries.astype(np.float64)
        if float(np.abs(queries).sum(axis=1).max(initial=0)) * self.largest >= EXACT:
            raise ValueError("components too large: scores beyond 2**53 are not exact")
        shape, n = self.values.shape, len(self.ids)
        others = query_ids[:, None] != self.ids[None, :]
        most = np.minimum(k, others.sum(axis=1))
        out = [(self.ids[:0], np.zeros(0, dtype=np.int64), Read(0, 0))] * len(queries)
        left = np.flatnonzero(most > 0)
        gain, known = np.zeros((len(left), n)), np.full(len(queries), -1)
        unseen_up, unseen_down = np.ones(shape), np.ones(shape)
        at, step = 0, first
        while len(left):
            to = min(n, at + step)
            up, down = np.maximum(queries[left], 0), np.minimum(queries[left], 0)
            for weights, unseen, entries in ((up, unseen_up, slice(n - to, n - at)), (down, unseen_down, slice(at, to))):
                shown = np.zeros(shape)
                np.put_along_axis(shown, self.who[:, entries], self.values[:, entries], axis=1)
                np.put_along_axis(unseen, self.who[:, entries], 0, axis=1)
                gain += weights @ shown
            at, step = to, 4 * step
            lower = upper = gain  # no entry is left, or:
            if at < n:
                lower = gain + (up * self.values[:, 0]) @ unseen_up + (down * self.values[:, -1]) @ unseen_down
                upper = gain + (up * self.values[:, n - 1 - at]) @ unseen_up + (down * self.values[:, at]) @ unseen_down
            lower, upper = np.where(others[left], lower, -np.inf), np.where(others[left], upper, -np.inf)
            done = np.zeros(len(left), dtype=bool)
            for j, i in enumerate(left.tolist()):
                least = np.partition(lower[j], n - most[i])[n - most[i]]
                if at < n and np.count_nonzero(upper[j] >= least) > most[i]:
                    continue  # some outsider may still qualify
                known[i] = at if known[i] < 0 else known[i]
                best = np.flatnonzero(lower[j] >= least)
                if at == n or (upper[j, best] == lower[j, best]).all():
                    best = best[np.lexsort((self.ids[best], -lower[j, best]))][: most[i]]
                    out[i] = self.ids[best], lower[j, best].astype(np.int64), Read(int(known[i]), at)
                    done[j] = True
            left, gain = left[~done], gain[~done]
        return out


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors null, empty or holding null or non-finite components are left out."""
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(finite)
    return kept.select("id", F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))


def exact_top_k(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = 20, block: int = 4096, query_block: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows, all if fewer.

    ``is_query`` is a predicate on ``id``. Rows that repeat an id and a vector are one; of different vectors with one
    id, the least counts. Vectors of unequal length never meet. An empty table gives an empty result. A task fails with a
    ValueError where a query's components and a candidate's could make a score of 2**53 or more, which would not be exact.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(rows.withColumn("dims", F.size("v")), "topk-vectors")
    counts = {r.dims: (r.n, r.q) for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}
    out = None
    for dims, (n, q) in sorted(counts.items()):
        if not q:
            continue
        parts, query_parts = -(-n // block), -(-q // query_block)
        own = rows.where(F.col("dims") == dims)
        side = lambda of, mine, other, kind: of.select(F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"), F.lit(kind).alias("is_query"), "id", "v")
        candidates = side(own, parts, query_parts, False).withColumnsRenamed({"mine": "part", "other": "query_part"})
        queries = side(own.where(is_query), query_parts, parts, True).withColumnsRenamed({"mine": "query_part", "other": "part"})

        def meet(batch: pd.DataFrame) -> pd.DataFrame:
            own_rows, asked = batch[~batch["is_query"]], batch[batch["is_query"]]
            if not len(own_rows) or not len(asked):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            lists = Lists(own_rows["id"].to_numpy(), np.stack(own_rows["v"].to_numpy()))
            ids = asked["id"].to_numpy()
            found = lists.top(np.stack(asked["v"].to_numpy()), ids, k)
            return pd.DataFrame({"query_id": np.repeat(ids, [len(f[0]) for f in found]), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])}).astype("int64")

        cells = candidates.unionByName(queries).repartition(max(1, min(parts * query_parts, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)), "part", "query_part")
        met = cells.groupBy("part", "query_part").applyInPandas(meet, SCHEMA)
        out = met if out is None else out.unionByName(met)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
