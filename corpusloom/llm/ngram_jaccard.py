"""Exact n-gram Jaccard self-join by parity sketches, in DataFrame functions only.

A document is the set of its distinct word shingles, as 63-bit hashes. Two sets a, b have
Jaccard similarity >= t exactly if their symmetric difference is at most
``(1 - t) / (1 + t) * (|a| + |b|)``.

The shingles of a set are spread over m blocks by the leading bits of their hash, and each
block keeps the XOR of its shingles: the parity sketch. A shingle in one set only changes
one block at most, so the number of blocks that differ (as the Hamming distance of the
sketches) is a lower bound of the symmetric difference. By the pigeonhole principle, two sets
within the bound of d agree on at least ``nonempty blocks - d`` of the nonempty blocks of each.

m depends on the size band of a set, [2^k, 2^(k+1)); sets just above a band also enter it, as
partners of smaller sets. Then:

1. texts with the same words are one class, whose least id stands for it;
2. block keys that one class alone has are dropped, and with them all classes
   that keep fewer than ``nonempty - d`` keys (nearly all that have no partner);
3. classes left that share one of their rarest ``kept - needed + 1`` keys make up a candidate component. Where its keys
   would make more pairs than it has (near copies agree on hundreds of keys), all of its pairs are candidates, else
   those that share such a key;
4. pairs whose 512-bit parity sketches differ in more bits than d are dropped, the rest is verified
   on the whole sets, gathered by candidate component and, where that is large, by cells of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import BROADCAST_IDS, WHITE, WHITE_CHARS, WORD, keep_ids, lower_ascii, materialize, one_text_an_id, words

MAX63 = "9223372036854775807L"
#: A part of a component holds about so many keys, and a cell of it about twice so many shingles, besides a single longer set.
CELL = 200_000
#: A key of more rows is cut in buckets of about so many.
HOT = 2000
#: All pairs of a component are compared if they are at most so many times those that its keys would make.
DENSE = 1.0
#: In components of so many sets, the sets are written as their differences from one of them.
PIVOT = 200
SKETCH_WORDS = 8


def _shingles(h: str, n: int) -> str:
    """SQL for the sorted distinct shingle hashes of an array of word hashes."""
    parts = ", ".join(["x"] + [f"{h}[i + {j}]" for j in range(1, n)])
    many = f"transform(slice({h}, 1, size({h}) - {n - 1}), (x, i) -> xxhash64({parts}) & {MAX63})"
    return f"CASE WHEN size({h}) >= {n} THEN sort_array(array_distinct({many})) WHEN size({h}) > 0 THEN array(xxhash64(0, {h}) & {MAX63}) ELSE CAST(array() AS array<bigint>) END"


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, s): the sorted distinct shingle hashes of each text with words; fewer than n words make one shingle.

    Texts without words are left out by a test of the text: a filter on the set itself would be pushed below
    the projections and have every array built again for each of its elements.
    """
    docs = docs.where(F.col("text").rlike(WORD))
    hashed = docs.select("id", words(lower_ascii(F.coalesce(F.col("text"), F.lit("")))).alias("w")).select("id", F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    return hashed.select("id", F.expr(_shingles("h", n)).alias("s"))


def _width(lo: str) -> str:
    """SQL for the number of blocks of the sketches of the band from lo."""
    return f"(CASE WHEN {lo} >= 64 THEN ({lo} * 5) div 4 ELSE {lo} * 2 END)"


def _block(x: str, m: str) -> str:
    """SQL for the block of hash x in a sketch of m blocks: its leading bits, scaled."""
    return f"shiftright(shiftright({x}, 32) * {m}, 31)"


def _blocks(m: str) -> str:
    """SQL for the blocks of all hashes of s."""
    return f"transform(s, x -> {_block('x', m)})"


def _starts(b: str) -> str:
    """SQL for the positions, from 1, at which a block of the sorted set s begins; b: the blocks of its hashes."""
    return f"filter(sequence(1, n), i -> i = 1 OR {b}[i - 1] <> get({b}, i - 2))"


def _keys(starts: str, b: str, lo: str) -> str:
    """SQL for the keys of the nonempty blocks: band, block and the XOR of its hashes."""
    part = f"slice(s, i, coalesce(get({starts}, k + 1), n + 1) - i)"
    return f"transform({starts}, (i, k) -> xxhash64({lo}, {b}[i - 1], aggregate({part}, 0L, (a, x) -> a ^ x)))"


def _when_any(condition: str, array: str, kind: str) -> str:
    return f"CASE WHEN {condition} THEN {array} ELSE CAST(array() AS array<{kind}>) END"


def sketch_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(id, key, tag, info): the block keys of each set.

    Tag 0 marks keys of the home band, 1 of the band below, 2 shingles. Tags 4 to 6 are one row each
    with the size (upper half of info) and the least number of keys of tag 0 to 2 that a partner shares.
    """
    num, den = 100 - percent, 100 + percent
    low = "(lo div 2)"
    enters = f"lo > 1 AND (n * {percent}L + 99) div 100 <= lo - 1"  # a partner may lie in the band below
    d_home = f"({num}L * (n + (n * 100L) div {percent})) div {den}"
    d_low = f"({num}L * (n + lo - 1)) div {den}"
    # What is the same for all hashes of a set is a column of its own: expressions in a lambda run for each of them.
    banded = (
        sets.withColumn("n", F.size("s"))
        .withColumn("lo", F.expr("CAST(shiftleft(1L, CAST(floor(log2(n + 0.5)) AS INT)) AS BIGINT)"))
        .select("id", "n", "s", "lo", F.expr(low).alias("low"), F.expr(enters).alias("enters"), F.expr(_width("lo")).alias("m1"), F.expr(_width(low)).alias("m2"))
        .select("*", F.expr(_blocks("m1")).alias("b1"), F.expr(_when_any("enters", _blocks("m2"), "bigint")).alias("b2"))
    )
    begun = banded.select("id", "n", "s", "lo", "low", "b1", "b2", F.expr(_starts("b1")).alias("f1"), F.expr(_when_any("enters", _starts("b2"), "int")).alias("f2"))
    keyed = begun.select(
        "id", "n", "s", F.size("f2").alias("z2"),
        F.expr(_keys("f1", "b1", "lo")).alias("k1"), F.expr(_when_any("size(f2) > 0", _keys("f2", "b2", "low"), "bigint")).alias("k2"),
        F.expr(f"size(f1) - {d_home}").alias("need1"), F.expr(f"size(f2) - {d_low}").alias("need2"),
    )
    # A need below 1 means that the sketch has too few nonempty blocks to promise one that agrees. Such a set keeps all
    # its keys; two such sets find each other by their shingles, of which they share at least percent%.
    tokens = _when_any("need1 < 1 OR (z2 > 0 AND need2 < 1)", "transform(s, x -> xxhash64('shingle', x))", "bigint")

    def told(tag: int, need: str) -> str:
        return f"array(struct(xxhash64(id, {tag}, 'told') AS key, {tag} AS tag, shiftleft(CAST(n AS BIGINT), 32) | CAST({need} AS BIGINT) AS info))"

    parts = [f"transform({keys}, k -> struct(k AS key, {tag} AS tag, 0L AS info))" for tag, keys in enumerate(("k1", "k2", "k3"))]
    none = "CAST(array() AS array<struct<key: bigint, tag: int, info: bigint>>)"
    parts.append(told(4, "greatest(need1, 1)"))
    parts.append(f"CASE WHEN z2 > 0 THEN {told(5, 'greatest(need2, 1)')} ELSE {none} END")
    parts.append(f"CASE WHEN size(k3) > 0 THEN {told(6, f'((n * {percent}L + 99) div 100)')} ELSE {none} END")
    return keyed.withColumn("k3", F.expr(tokens)).select("id", F.expr(f"inline(concat({', '.join(parts)}))"))


def _with_ids(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Join with a materialized table of one row an id, which is broadcast if its rows are few enough."""
    return rows.join(F.broadcast(of) if of.count() <= BROADCAST_IDS else of, key)


def _by_cell(spark: SparkSession, write):
    """Runs ``write`` with joins that accept sides laid out by their cell alone, as both are here."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return write()
    finally:
        spark.conf.set(setting, was)


def candidate_pairs(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, component, dense): the component (id, component) of all that could be paired; of dense ones, all pairs of which
    are to be compared, the sets (id, component, g, pivot, bucket) dealt to g buckets, and the id of one of them in large ones;
    of the others the distinct pairs a < b that agree on a key each of them must look at, with their sizes.

    A key that more than ``HOT`` sets look at is cut in buckets, and its pairs are made bucket by bucket, so that no task
    makes all of them. A pair may agree on hundreds of keys. The keys of a component are therefore laid out together (a large one's in several
    parts), so that its pairs are made and made distinct in place, before they are shuffled.
    """
    spark = rows.sparkSession
    told = rows.where("tag >= 4").select("id", (F.col("tag") - 4).alias("tag"), F.shiftright("info", 32).cast("int").alias("n"), F.col("info").bitwiseAND(2**32 - 1).cast("int").alias("need"))
    of = Window.partitionBy("id", "tag")
    # One shuffle by (id, tag) both counts and ranks the keys of a set.
    kept = rows.where("tag < 4").withColumns({"c": F.count("*").over(of), "r": F.row_number().over(of.orderBy("together", "key"))})
    looked = materialize(kept.join(told, ["id", "tag"]).where("c >= need AND r <= c - need + 1").select("key", "id", "tag", "n"), "ng-prefixes")
    # Counted by partial aggregates; the join back may be split where a key is hot, as a window could not.
    hubs = looked.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("held"))
    looked = materialize(looked.join(hubs, "key"), "ng-looked")
    component = connected_components(looked.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    # A key of c rows makes c * c pairs, c for each of its rows.
    each = looked.groupBy("id").agg(F.count("*").alias("keys"), F.sum("held").alias("made"), F.max("n").alias("n"), F.max(F.struct("held", "hub")).alias("top")).join(component, "id")
    weight = each.groupBy("component").agg(
        F.ceil(F.sum("keys") / F.lit(CELL)).cast("int").alias("parts"),
        F.expr(f"CAST(greatest(ceil(sum(n) / {CELL}), ceil(count(*) / {HOT})) AS INT)").alias("g"),
        F.expr(f"CAST(count(*) AS DOUBLE) * count(*) <= {DENSE} * sum(made)").alias("dense"),
        F.expr(f"CASE WHEN count(*) >= {PIVOT} THEN max(top).hub END").alias("pivot"),
    )
    places = materialize(component.join(weight, "component"), "ng-parts")
    dense = materialize(places.where("dense").select("id", "component", "g", "pivot", F.expr("CAST(pmod(xxhash64(id), g) AS INT)").alias("bucket")), "ng-dense")
    sparse = materialize(places.where("NOT dense").select("id", "component", "parts"), "ng-sparse")
    # A hot key's rows are cut in as many buckets as it needs, and each two buckets meet in a cell of their own.
    splits = F.ceil(F.col("held") / F.lit(HOT)).cast("int").alias("splits")
    placed = _with_ids(looked.select("key", "id", "tag", "n", splits), sparse, "id").withColumn("bucket", F.expr("CAST(pmod(xxhash64(id), splits) AS INT)")).withColumn("other", F.expr("explode(sequence(0, splits - 1))"))
    cell = "CASE WHEN splits = 1 THEN xxhash64(component, pmod(key, parts)) ELSE xxhash64(component, key, least(bucket, other), greatest(bucket, other)) END"
    laid = placed.select("key", "id", "tag", "n", "bucket", "other", F.expr(cell).alias("cell"))
    laid = laid.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell")
    a, b = (laid.select("cell", "key", *(F.col(c).alias(f"{to}{x}") for c, to in (("id", ""), ("tag", "t"), ("n", "n"), ("bucket", "bucket_"), ("other", "other_")))) for x in "ab")
    once = "(bucket_a <> bucket_b OR (bucket_a = other_a AND bucket_b = other_b))"  # rows of one bucket meet in its own cell only
    near = f"a < b AND NOT (ta = 1 AND tb = 1) AND {once} AND 100L * least(na, nb) >= {percent}L * greatest(na, nb)"
    joined = a.join(b, ["cell", "key"]).where(near).select("a", "b", "na", "nb").distinct()
    return _by_cell(spark, lambda: materialize(joined, "ng-pairs")), component, dense


def _near_sketches(percent: int) -> str:
    """SQL: the sketches of a pair differ in no more bits than its sets may differ in shingles."""
    apart = " + ".join(f"bit_count(bits_a[{w}] ^ bits_b[{w}])" for w in range(SKETCH_WORDS))
    return f"{apart} <= ({100 - percent}L * (na + nb)) div {100 + percent}"


def sketched(sets: DataFrame) -> DataFrame:
    """(id, s, n, bits): sets with their size and 512-bit parity sketch."""
    bits = [F.expr(f"aggregate(s, 0L, (v, x) -> CASE WHEN (x & {SKETCH_WORDS - 1}) = {w} THEN v ^ shiftleft(1L, CAST(shiftright(x, 3) & 63 AS INT)) ELSE v END)") for w in range(SKETCH_WORDS)]
    return sets.select("id", "s", F.size("s").alias("n"), F.array(*bits).alias("bits"))


def verified_dense(dense: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: all pairs within a component of ``dense`` whose sets are similar enough. Each two of its buckets meet in one cell.

    Two sets differ in as many shingles as their differences from a third one, the pivot, do. Those of near copies are short,
    and where both together are within the bound, there is nothing to compare.
    """
    num, den = 100 - percent, 100 + percent
    parts = int(dense.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pivots = materialize(sets.join(F.broadcast(dense.select(F.col("pivot").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("pivot"), F.col("s").alias("p")), "ng-pivots")
    few = (pivots.agg(F.sum(F.size("p"))).first()[0] or 0) <= 8_000_000
    held = _with_ids(sets, dense, "id").join(F.broadcast(pivots) if few else pivots, "pivot", "left")
    held = held.withColumn("s", F.expr("CASE WHEN p IS NULL THEN s ELSE concat(array_except(s, p), array_except(p, s)) END"))

    def side(x: str, others: str) -> DataFrame:
        spread = held.withColumn("other", F.expr(f"explode({others})"))
        cell = F.expr("xxhash64(component, least(bucket, other), greatest(bucket, other))").alias("cell")
        return spread.select(cell, F.col("id").alias(x), *(F.col(c).alias(f"{c}{to}{x}") for c, to in (("n", ""), ("s", ""), ("bits", "_"), ("bucket", "_")))).repartition(parts, "cell")

    met = side("a", "sequence(bucket, g - 1)").join(side("b", "sequence(0, bucket)").hint("shuffle_hash"), "cell")
    met = met.where(f"(bucket_a < bucket_b OR a < b) AND 100L * least(na, nb) >= {percent}L * greatest(na, nb) AND {_near_sketches(percent)}")
    bound = f"{num}L * (na + nb)"
    kept = met.where(f"CASE WHEN {den}L * (size(sa) + size(sb)) <= {bound} THEN true WHEN {den}L * abs(size(sa) - size(sb)) > {bound} THEN false ELSE {den}L * (size(sa) + size(sb) - 2 * size(array_intersect(sa, sb))) <= {bound} END")
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough. Sets travel once a cell of their component, not once a pair."""
    spark = pairs.sparkSession
    sizes = pairs.select(F.col("a").alias("id"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("id"), F.col("nb").alias("n"))).distinct()
    placed = component.join(sizes, "id")
    weight = placed.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(CELL)).cast("int").alias("g"))
    places = materialize(placed.join(weight, "component").select("id", "component", "g", F.expr("CAST(pmod(xxhash64(id), g) AS INT)").alias("bucket")), "ng-places")
    cell = lambda x, y: F.expr(f"xxhash64(component, least({x}, {y}), greatest({x}, {y}))").alias("cell")
    at_a, at_b = places.select(F.col("id").alias("a"), "component", F.col("bucket").alias("bucket_a")), places.select(F.col("id").alias("b"), F.col("bucket").alias("bucket_b"))
    met = _with_ids(_with_ids(pairs, at_a, "a"), at_b, "b").select("a", "b", "na", "nb", cell("bucket_a", "bucket_b"))
    spread = _with_ids(sets, places, "id").withColumn("other", F.expr("explode(sequence(0, g - 1))")).select("id", "s", "bits", cell("bucket", "other"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met, spread = met.repartition(parts, "cell"), spread.repartition(parts, "cell")
    side = lambda x: spread.select("cell", F.col("id").alias(x), F.col("s").alias(f"s{x}"), F.col("bits").alias(f"bits_{x}")).hint("shuffle_hash")
    joined = met.join(side("a"), ["cell", "a"]).join(side("b"), ["cell", "b"])
    shared = joined.where(_near_sketches(percent)).select("a", "b", "na", "nb", F.expr("size(array_intersect(sa, sb))").alias("both"))
    linked = shared.where(f"100L * both >= {percent}L * (na + nb - both)").select("a", "b").distinct()
    return _by_cell(spark, lambda: materialize(linked, "ng-links"))


def jaccard_links(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 70) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: id, rep (the least id of its class), n_shingles, of every document with words.
    links: a < b, representatives with 100 * |intersection| >= percent * |union|.
    Null and blank texts are in neither; rows with a null id are no documents.
    """
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sequence = F.regexp_replace(F.btrim(lower_ascii(F.col("text")), F.lit(WHITE_CHARS)), WHITE, " ")

    def digests(rows: DataFrame) -> DataFrame:
        # Texts without words are left out by a test of the text: one of the digest would have it made twice.
        return materialize(rows.where(F.col("text").rlike(WORD)).select("id", F.md5(sequence).alias("digest")), "ng-texts")

    texts = digests(source)
    single = one_text_an_id(source, texts)
    if single is not source:
        source, texts = single, digests(single)
    classes = materialize(texts.groupBy("digest").agg(F.min("id").alias("rep")), "ng-classes")
    members = materialize(texts.join(classes, "digest").select("id", "rep"), "ng-members")
    copies = materialize(members.where("id <> rep").select("id"), "ng-copies")

    rows = sketch_rows(shingle_sets(keep_ids(source, copies, "id", "left_anti"), n), percent)
    together = F.count("*").over(Window.partitionBy("key")).alias("together")
    rows = materialize(rows.select("id", "key", "tag", "info", together).where("together > 1 OR tag >= 4"), "ng-keys")
    pairs, component, dense = candidate_pairs(rows, percent)
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(dense.select("id")).distinct(), "ng-ids")
    sets = materialize(sketched(shingle_sets(keep_ids(source, ids, "id"), n)), "ng-sets")
    links = materialize(verified_dense(dense, sets, percent), "ng-dense-links").unionByName(verified(pairs, sets, component, percent))
    counts = rows.where("tag = 4").select(F.col("id").alias("rep"), F.shiftright("info", 32).alias("n_shingles"))
    return members.join(counts, "rep"), links


def similar_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 70) -> DataFrame:
    """One row a document: doc_id, n_shingles, n_similar, component_id.

    Null texts and texts without words have an empty set, are linked with nothing and are their own component. Rows
    with a null id are left out; rows that repeat an id are one document (the least text of them). An empty
    table gives an empty result. Only the two named columns are read.
    """
    members, links = jaccard_links(docs, key=key, text=text, n=n, percent=percent)
    members = materialize(members, "ng-sized")
    weight = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    linked = ends.join(weight.select(F.col("rep").alias("other"), F.col("copies").alias("theirs")), "other").groupBy("rep").agg(F.sum("theirs").alias("linked"))
    component = connected_components(links).select(F.col("id").alias("rep"), F.col("component").alias("component_id"))
    classes = weight.join(linked, "rep", "left").join(component, "rep", "left")
    found = members.join(classes, "rep").select(
        F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), F.coalesce("component_id", "rep").alias("component_id"),
    )
    rest = docs.select(F.col(key).alias("doc_id")).where("doc_id IS NOT NULL").distinct().join(found.select("doc_id"), "doc_id", "left_anti")
    none = F.lit(0).cast("long")
    return found.unionByName(rest.select("doc_id", none.alias("n_shingles"), none.alias("n_similar"), F.col("doc_id").alias("component_id")))
