"""Benchmark decontamination by SimHash windows.

An item is fingerprinted by the SimHash of its words (weight: rarity among the items), and so is every window of a text that is
as long as an item of that length. The items' fingerprints are searched through a multi-index: four blocks of 16
bits, each entered with all values up to radius / 4 bits away, so by the pigeonhole principle every item
within the radius of a window's fingerprint shares an entry with it. The items found are verified by the exact
weighted Jaccard similarity of word shingles.

A window that cannot be similar to any item is not fingerprinted: its shingles that some item has must weigh the
threshold's share of the lightest item of that length and of the window's other shingles. That drops no window that could
be verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .tokens import Codes, shingles

BLOCKS, BLOCK_BITS = 4, 16
SCHEMA = "doc_id long, item_id long, start_word int, n_words int, hamming int, similarity double"
#: Words of a text in which windows begin that are searched at a time.
AT_ONCE = 8192


def _signs(codes: np.ndarray) -> np.ndarray:
    mixed = codes * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 1e-9).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=-1, dtype=np.uint64)


def within(value: int, radius: int, bits: int = BLOCK_BITS) -> Iterator[int]:
    """All values up to radius bits away."""
    for n in range(radius + 1):
        for flipped in combinations(range(bits), n):
            yield value ^ sum(1 << b for b in flipped)


def coded(items: Iterable[tuple[int, str | None]]) -> list[tuple[int, np.ndarray]]:
    """(id, word codes) of the items that have words, in order of id; rows that repeat an id and a text are one."""
    codes_of = Codes()
    rows = [(i, codes_of.of(t)) for i, t in sorted({x for x in items if x[0] is not None}, key=lambda x: (x[0], x[1] or ""))]
    return [(i, c) for i, c in rows if len(c)]


class Weights:
    """Rarity of codes among the items: 1 + ln(items / items that have it); what no item has is as rare as can be."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, items: int):
        order = np.argsort(codes)
        self.codes, self.known = codes[order], 1 + np.log(np.maximum(items, 1) / np.maximum(counts[order], 1))
        self.rest = 1 + float(np.log(max(items, 1)))

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, whether an item has it) of each code."""
        if not len(self.codes):
            return np.full(len(codes), self.rest), np.zeros(len(codes), dtype=bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        return np.where(hit, self.known[at], self.rest), hit


def item_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """The distinct codes of an item that rarity is counted for: words, and shingles (of k words, or all where there are fewer)."""
    return np.unique(np.concatenate([codes, shingles(codes, k)]))


@dataclass
class Length:
    """The items of one number of words, and their multi-index: the entries of all values of all blocks end to end, and where each value's begin."""

    items: np.ndarray
    prints: np.ndarray
    least: float
    begins: np.ndarray
    entries: np.ndarray

    def near(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint number, item of this length) of all that share an entry, as often as they do: every pair within the radius, and some beyond."""
        blocks = np.arange(BLOCKS, dtype=np.uint64)[:, None]
        v = (((fingerprints >> (np.uint64(BLOCK_BITS) * blocks)) & np.uint64(0xFFFF)) + (blocks << np.uint64(BLOCK_BITS))).astype(np.int64).ravel()
        begins = self.begins[v].astype(np.int64)
        n = self.begins[v + 1] - begins
        return np.repeat(np.tile(np.arange(len(fingerprints)), BLOCKS), n), self.entries[np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())]


@dataclass
class Benchmark:
    """The items, ready to be searched for."""

    ids: list[int]
    sets: list[tuple[np.ndarray, np.ndarray]]
    totals: np.ndarray
    prints: np.ndarray
    lengths: dict[int, Length]
    weights: Weights
    k: int
    radius: int
    threshold: float

    @classmethod
    def build(cls, items: Iterable[tuple[int, str | None]], k: int = 2, radius: int = 19, threshold: float = 0.35, weights: Weights | None = None) -> Benchmark:
        """Items without words are left out. ``weights`` are those of all items, where these are a part of them."""
        rows = coded(items)
        if weights is None:
            all_, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(item_codes(c, k) for _, c in rows)]), return_counts=True)
            weights = Weights(all_, counts, len(rows))
        own = [np.unique(shingles(c, k)) for _, c in rows]
        sets = [(s, weights.of(s)[0]) for s in own]
        totals = np.array([w.sum() for _, w in sets])
        prints = np.array([_pack((_signs(c) * weights.of(c)[0][:, None]).sum(axis=0)) for _, c in rows], dtype=np.uint64)
        sizes = np.array([len(c) for _, c in rows], dtype=int)
        masks = np.array(list(within(0, radius // BLOCKS)), dtype=np.uint16)
        lengths = {}
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            blocks = [((prints[mine] >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.uint16)[:, None] ^ masks for b in range(BLOCKS)]
            entries = np.concatenate([x.ravel().astype(np.int64) + (b << BLOCK_BITS) for b, x in enumerate(blocks)])
            order = np.argsort(entries, kind="stable")
            begins = np.searchsorted(entries[order], np.arange((BLOCKS << BLOCK_BITS) + 1)).astype(np.int32)
            owners = np.tile(np.repeat(np.arange(len(mine), dtype=np.int32), len(masks)), BLOCKS)[order]
            lengths[size] = Length(mine, prints[mine], float(totals[mine].min()), begins, owners)
        return cls([i for i, _ in rows], sets, totals, prints, lengths, weights, k, radius, threshold)

    @cached_property
    def groups(self) -> dict[int, list[tuple[list[int], float]]]:
        """By the words of their shingles (of an item of fewer words, all), the lengths in groups of eight, and the least total weight of each."""
        out: dict[int, list[tuple[list[int], float]]] = {}
        for k in sorted({min(self.k, size) for size in self.lengths}):
            sizes = sorted(size for size in self.lengths if min(self.k, size) == k)
            out[k] = [(g, min(self.lengths[size].least for size in g)) for g in (sizes[i : i + 8] for i in range(0, len(sizes), 8))]
        return out

    def search(self, codes: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(item number, start, words, hamming, similarity) of the best window of each item found in a text."""
        found: dict[int, tuple[float, int, int, int]] = {}
        longest = max(self.lengths, default=0)
        # Windows begin in one stretch and may end in the next, so memory doesn't grow with the text.
        for begin in range(0, len(codes) if longest else 0, AT_ONCE):
            part = codes[begin : begin + AT_ONCE + longest - 1]
            for k, groups in self.groups.items():
                if len(part) >= k:
                    self._search(part, begin, k, groups, longest, found)
        return [(n, -start, size, -apart, round(similarity, 6)) for n, (similarity, apart, start, size) in sorted(found.items())]

    def _search(self, codes: np.ndarray, begin: int, k: int, groups: list[tuple[list[int], float]], longest: int, found: dict[int, tuple[float, int, int, int]]) -> None:
        s = shingles(codes, k)
        w, hit = self.weights.of(s)
        if not hit.any():
            return
        total = np.concatenate([[0], np.cumsum(w * hit)])
        bound = sums = None
        # A window's shared weight is at most that of its shingles that items have (repeats counted): first seen to for several lengths at once.
        for group, least in groups:
            width = min(group[-1], len(codes)) - k + 1
            if float((total[width:] - total[:-width]).max()) < self.threshold * least - 1e-9:
                continue
            if bound is None:
                # What is shared also weighs against the rest of the window: its other shingles, but those that repeat within reach.
                order = np.argsort(s, kind="stable")
                again = np.flatnonzero(s[order[1:]] == s[order[:-1]])
                fresh = np.ones(len(s), dtype=bool)
                fresh[order[again + 1][order[again + 1] - order[again] < longest]] = False
                bound = total - self.threshold * np.concatenate([[0], np.cumsum(w * (fresh & ~hit))])
            for size in group:
                if size > len(codes):
                    break
                length, width = self.lengths[size], size - k + 1
                starts = np.flatnonzero(bound[width:] - bound[:-width] >= self.threshold * length.least - 1e-9)
                starts = starts[starts < AT_ONCE]
                if not len(starts):
                    continue
                if sums is None:
                    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(_signs(codes) * self.weights.of(codes)[0][:, None], axis=0)])
                prints = _pack(sums[starts + size] - sums[starts])
                whose, which = length.near(prints)
                apart = np.bitwise_count(prints[whose] ^ length.prints[which])
                reach = bound[starts + width] - bound[starts]
                able = np.flatnonzero((apart <= self.radius) & (reach[whose] >= self.threshold * self.totals[length.items[which]] - 1e-9))
                able = able[np.unique(whose[able] * len(length.items) + which[able], return_index=True)[1]]
                for j in able[np.argsort(apart[able], kind="stable")].tolist():
                    n, start = int(length.items[which[j]]), int(starts[whose[j]])
                    if n in found and found[n][:2] == (1.0, 0):
                        continue  # nothing is better, and the first of equals came first
                    similarity = self.similarity(s[start : start + width], w[start : start + width], n)
                    new = (round(similarity, 12), -int(apart[j]), -(start + begin), size)
                    if similarity >= self.threshold and (n not in found or new > found[n]):
                        found[n] = new

    def similarity(self, window: np.ndarray, weights: np.ndarray, n: int) -> float:
        """Weighted Jaccard similarity of the distinct shingles of a window and item n."""
        distinct, first = np.unique(window, return_index=True)
        own, own_weights = self.sets[n]
        at = np.minimum(np.searchsorted(own, distinct), len(own) - 1)
        shared = float(own_weights[at[own[at] == distinct]].sum())
        return shared / (float(weights[first].sum()) + float(self.totals[n]) - shared)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most_items: int = 2000, **settings) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window for each item that a text holds.

    Rarity is counted over all items by a DataFrame aggregation. The items are fetched and sent to all executors ``most_items`` at
    a time at most, each part with the rarity of its own codes, and the texts are searched once a part. Null and empty texts hold nothing; null
    ids and other columns are passed by; rows that repeat are judged alike; an empty benchmark or table gives an empty
    result. Only the named columns are read.
    """
    spark = docs.sparkSession
    k = settings.get("k", 2)
    items = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes_of = Codes()
        for batch in batches:
            found = [(i, t, item_codes(c, k).view(np.int64).tolist()) for i, t in zip(batch["i"], batch["t"], strict=True) if len(c := codes_of.of(t))]
            yield pd.DataFrame(found, columns=["i", "t", "codes"])

    items = materialize(items.mapInPandas(codes, "i long, t string, codes array<long>"), "leak-items")
    total = items.count()
    counts = items.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    passes = max(1, -(-total // most_items))
    part_of = F.pmod(F.xxhash64("i", "t"), F.lit(passes)).cast("int")
    rows, out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), None
    weighed = materialize(items.select(part_of.alias("part"), F.explode("codes").alias("code")).distinct().join(counts, "code"), "leak-weights")
    for p in range(passes):
        own = weighed.where(F.col("part") == p).select("code", "n").toPandas()
        weights = Weights(own["code"].to_numpy(dtype=np.int64).view(np.uint64), own["n"].to_numpy(dtype=float), total)
        shared = spark.sparkContext.broadcast(Benchmark.build([(r.i, r.t) for r in items.where(part_of == p).select("i", "t").collect()], weights=weights, **settings))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            codes_of, b = Codes(), shared.value
            for batch in batches:
                found = []
                for at in range(0, batch.num_rows, 512):
                    ids, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                    found += [(d, b.ids[n], *rest) for d, t in zip(ids, texts, strict=True) for n, *rest in b.search(codes_of.of(t))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        leaks = rows.mapInArrow(run, SCHEMA)
        out = leaks if out is None else out.unionByName(leaks)
    return out
