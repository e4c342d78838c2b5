"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target number of words. A document is expected in the mix in proportion to its importance (its size
class, times that of a column, if one is given), so that the words expected sum to the target; no document more than a few times:
the whole part of that number is allocated for certain, and for the fractional part p
the documents are ranked by the random odds over the inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and taken from the lowest up while their words fit
what the whole copies leave of the target. One closing document then fills the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize

#: Ranks are cut in so many bins, so that a cumulative sum never needs a whole source in one task.
BINS = 4096
#: Words from which a document has a weight: short pieces are worth less than articles.
SIZE_CLASSES = ((0, 1), (64, 2), (512, 3))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_copies: int = 3) -> DataFrame:
    """Per source: its size and target, from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share all words.
    A target is at most ``most_copies`` times the source's size; the excess is shared
    again by weight. That is a water level: with the sources sorted by cap over weight, the
    first that is not capped fixes the level for itself and all after it.
    The windows run over one row a source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_copies)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    levelled = sources.withColumn("here", level).withColumn("turn", F.row_number().over(by_level))
    free = F.when(F.col("cap") > F.col("here") * F.col("weight"), F.struct("turn", "here"))
    levelled = levelled.withColumn("level", F.min(free).over(Window.partitionBy())["here"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def expected_copies(rows: DataFrame, targets: DataFrame, most_copies: int) -> DataFrame:
    """(of, no_source, importance, expected): how often a document of a source and an importance is expected in the mix.

    In proportion to the importance, ``most_copies`` at most; what that cuts off falls to the others of the source, so that
    the words expected are the target. That is a water level again: of the importances from the greatest down, the first that is not cut off
    fixes the level. The windows run over one row for each importance of a source, of which rounding leaves few.
    """
    on = ["of", "no_source"]
    sums = rows.where("importance > 0").groupBy(*on, "importance").agg(F.sum("size").alias("words")).join(targets.select(*on, "target"), on)
    order = Window.partitionBy(*on).orderBy(F.desc("importance"))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("words") * F.col("importance")).over(order.rowsBetween(0, Window.unboundedFollowing))
    here = F.when(onward > 0, (F.col("target") - before * most_copies) / onward)
    levels = sums.withColumn("here", here)
    free = F.when(F.col("here") * F.col("importance") < most_copies, F.struct(-F.col("importance"), "here"))
    level = F.min(free).over(Window.partitionBy(*on))["here"]
    return levels.withColumn("level", level).select(*on, "importance", F.coalesce(F.least(F.col("level") * F.col("importance"), F.lit(float(most_copies))), F.lit(float(most_copies))).alias("expected"))


def mix_sources(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    importance: str | None = None,
    size_classes: tuple[tuple[int, float], ...] = SIZE_CLASSES,
    weights: tuple[float, ...] = (5, 2, 1),
    most_copies: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, copies, taken (= copies * size).

    Null texts and texts without words have size 0 and are never taken; a null source is a
    source of its own, last in order; a null key takes part under the empty key. Rows that
    repeat a key share their random number; ties rank by key, then size, so the outcome
    doesn't depend on the order of rows. An empty table gives an empty result. Only the named
    columns are read, so further columns of any name do no harm.

    A document's chances are in proportion to the weight of its size class (pairs of the least number of words and a weight, the
    greatest that fits counts) and, if one is given, to a column of importance, rounded to 8 binary digits; null or less than 0
    counts as 0, which is never taken.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        (F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(0.0)), F.lit(0.0)) if importance else F.lit(1.0)).alias("importance"),
    )
    of_size = F.lit(0.0)
    for least, weight in sorted(size_classes):
        of_size = F.when(F.col("size") >= least, float(weight)).otherwise(of_size)
    unit = F.pow(F.lit(2.0), F.floor(F.log2("importance")) - 7)
    rounded = F.when(F.col("importance") > 0, F.round(F.col("importance") / unit) * unit).otherwise(0.0) if importance else F.col("importance")
    rows = rows.withColumn("importance", rounded * of_size).withColumn("of", F.coalesce(F.col("source"), F.lit(""))).withColumn("no_source", F.col("source").isNull())
    rows = materialize(rows, "mix-sizes")  # the texts are read once
    targets = source_targets(rows, weights, most_copies)
    targets = materialize(targets.withColumn("of", F.coalesce(F.col("source"), F.lit(""))).withColumn("no_source", F.col("source").isNull()), "mix-targets")
    on = ["of", "no_source"]
    expected = materialize(expected_copies(rows, targets, most_copies), "mix-expected")
    u = uniform(F.col("doc_id"), seed)
    ranked = (
        rows.drop("source")
        .join(targets.drop("source", "weight"), on)
        .join(expected, [*on, "importance"], "left")
        .withColumn("expected", F.when(F.col("size") > 0, F.coalesce("expected", F.lit(0.0))).otherwise(0.0))
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("u", u)
        .withColumn("rank", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
        .select("doc_id", *on, "size", "source_size", "target", "whole", "rank", "bin")
    )
    ranked = materialize(ranked, "mix-ranks")

    certain = ranked.groupBy(*on).agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    bins = ranked.where("rank IS NOT NULL").groupBy(*on, "bin").agg(F.sum("size").alias("words"))
    reach = Window.partitionBy(*on).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        bins.withColumn("before", F.coalesce(F.sum("words").over(reach), F.lit(0)))
        .join(certain, on).join(targets.select(*on, "target"), on)
        .withColumn("left", F.col("target") - F.col("certain") - F.col("before"))
        .select(*on, "bin", "before", "certain", F.when(F.col("words") <= F.col("left"), 1).when(F.col("left") > 0, 0).otherwise(-1).alias("fits"), "left")
    )
    placed = ranked.join(bins, [*on, "bin"], "left")
    # Only the bin in which a target is reached needs an order by row: a 4096th of a source.
    edge = placed.where("fits = 0")
    run = Window.partitionBy(*on, "bin").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("more", (F.sum("size").over(run) <= F.col("left")).cast("int"))
    rest = placed.where("fits IS NULL OR fits <> 0").withColumn("more", F.when(F.col("fits") == 1, 1).otherwise(0))
    columns = ["doc_id", *on, "size", "source_size", "target", "whole", "rank", "more"]
    chosen = materialize(edge.select(*columns).unionByName(rest.select(*columns)), "mix-chosen")

    # The closing document of a source: the one whose words bring it nearest to its target, if nearer than without it.
    gap = chosen.groupBy(*on, "target").agg(F.sum((F.col("whole") + F.col("more")) * F.col("size")).alias("sum"))
    gap = gap.select(*on, (F.col("target") - F.col("sum")).alias("gap"))
    close = F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("rank"), F.col("doc_id"), F.col("size"))
    closing = (
        chosen.where(F.expr(f"more = 0 AND size > 0 AND rank IS NOT NULL AND whole < {int(most_copies)}"))
        .join(gap, on).where(F.abs(F.col("size") - F.col("gap")) < F.abs(F.col("gap")))
        .groupBy(*on).agg(F.min(close).alias("c"))
        .select(*on, F.col("c.rank").alias("rank"), F.col("c.doc_id").alias("closing_id"), F.col("c.size").alias("size"))
    )
    # Of rows that repeat a key and a size, one alone closes.
    closing = closing.withColumn("closes", F.lit(1))
    same = (F.col("d.of") == F.col("c.of")) & (F.col("d.no_source") == F.col("c.no_source")) & (F.col("d.rank") == F.col("c.rank")) & F.col("d.doc_id").eqNullSafe(F.col("c.closing_id")) & (F.col("d.size") == F.col("c.size")) & (F.col("d.more") == 0)
    marked = chosen.alias("d").join(closing.alias("c"), same, "left").select("d.*", F.coalesce(F.col("c.closes"), F.lit(0)).alias("closes"))
    once = marked.where("closes = 1").withColumn("n", F.row_number().over(Window.partitionBy(*on).orderBy("rank")))
    marked = marked.where("closes = 0").withColumn("n", F.lit(0)).unionByName(once)
    copies = (F.col("whole") + F.col("more") + F.when(F.col("n") == 1, 1).otherwise(0)).cast("long")
    return marked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
