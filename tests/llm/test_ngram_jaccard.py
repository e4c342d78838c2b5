"""The similarity join against all pairs, and its rows at the edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_jaccard as ng
from corpusloom.llm.components import connected_components


def brute(rows, n=3, percent=70):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids, links = sorted(sets), {i: set() for i in sets}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b)
                links[b].add(a)
    component = {}
    for i in ids:
        if i not in component:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in component:
                    component[j] = i
                    todo += links[j]
    return {i: (len(sets[i]), len(links[i]), component[i]) for i in ids}


def got(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("key", F.lit(1))
    return {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in ng.similar_documents(docs, **settings).collect()}


def variants(rng, base, count, most):
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [w[at], f"m{rng.randrange(10**6)}"]])
        yield " ".join(w)


@pytest.mark.parametrize(("cell", "hot"), [(200_000, 2000), (150, 3)])  # the smaller ones cut components and keys into many parts
def test_all_links_near_the_threshold(spark, monkeypatch, cell, hot):
    monkeypatch.setattr(ng, "CELL", cell)
    monkeypatch.setattr(ng, "HOT", hot)
    rng = random.Random(5)
    texts = []
    for size in (1, 2, 3, 4, 5, 7, 9, 16, 20, 33, 40, 64, 90, 130, 200):
        base = [f"w{rng.randrange(size * 2)}" for _ in range(size)]
        texts += variants(rng, base, 14, max(1, size // 8))
    passage = " ".join(f"p{k}" for k in range(30))  # shared by many, near-copies of none
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(60)) for _ in range(25)]
    texts += ["Same WORDS here", "same words\there", "É x y", "é x y"]
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


def test_sketches_too_small_for_their_sets_lose_nothing(spark, monkeypatch):
    # Nearly all hashes in one block: needs fall below 1, and shingles take over.
    monkeypatch.setattr(ng, "_block", lambda x, lo: f"shiftright({x}, 61)")
    rng = random.Random(6)
    rows = list(enumerate(t for size in (5, 12, 40) for t in variants(rng, [f"w{k}" for k in range(size)], 8, 3)))
    assert got(spark, rows) == brute(rows)


def test_one_hot_group_is_cut_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(ng, "HOT", 7)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = list(enumerate([*variants(rng, base, 90, 2), *(" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60))]))
    assert got(spark, rows) == brute(rows)
    docs = spark.createDataFrame(rows, "id long, text string")
    from pyspark.sql import Window

    keyed = ng.sketch_rows(ng.shingle_sets(docs, 3), 70).withColumn("together", F.count("*").over(Window.partitionBy("key"))).where("together > 1 OR tag >= 4")
    pairs = ng.candidate_pairs(keyed, 70)[0].collect()
    assert len(pairs) == len({(r.a, r.b) for r in pairs})


@pytest.mark.parametrize(("dense", "pivot", "hot"), [(0, 200, 2000), (1e9, 10**9, 5), (1e9, 2, 5), (1, 2, 2000)])
def test_all_pairs_of_a_component_or_those_of_its_keys(spark, monkeypatch, dense, pivot, hot):
    monkeypatch.setattr(ng, "DENSE", dense)
    monkeypatch.setattr(ng, "PIVOT", pivot)
    monkeypatch.setattr(ng, "HOT", hot)
    rng = random.Random(15)
    texts = [t for size in (3, 6, 15, 40, 90) for t in variants(rng, [f"w{rng.randrange(size * 2)}" for _ in range(size)], 20, max(1, size // 6))]
    line = " ".join(f"p{k}" for k in range(25))  # in two groups and in others
    texts += [f"{line} {t}" for size in (30, 31) for t in variants(rng, [f"q{rng.randrange(size)}" for _ in range(size)], 15, 6)] + [line + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(20)) for _ in range(15)]
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


def test_near_copies_make_no_pair_for_each_key_they_share(spark, monkeypatch):
    made = {}
    real = ng.materialize
    monkeypatch.setattr(ng, "materialize", lambda df, name: made.setdefault(name, real(df, name)))
    rng = random.Random(16)
    rows = list(enumerate(variants(rng, [f"w{k}" for k in range(80)], 60, 3)))
    assert got(spark, rows) == brute(rows)
    assert made["ng-looked"].groupBy("key").count().where("count > 20").count() > 10  # many keys, each of many sets
    assert made["ng-pairs"].count() == 0


def test_edges(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A b"), (6, long), (7, long + " end"), (None, "a b"), (8, "\x85"), (9, "a b c"), (9, "a b c")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(1, "b c d"), (1, "a b c"), (2, "a b c")]) == {1: (1, 1, 1), 2: (1, 1, 1)}  # the least text of an id counts
    assert got(spark, []) == {}


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 300) if i % 100 != 99] + [(rng.randrange(1000, 1500), rng.randrange(1000, 1500)) for _ in range(300)] + [(5000, 5000), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e")], "id long, text string")
    plan = ng.sketch_rows(ng.shingle_sets(docs, 3), 70)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_texts_are_split_once_for_their_digests(spark, monkeypatch):
    from corpusloom.llm import ngram_jaccard

    plans = {}

    def kept(df, name, write=ngram_jaccard.materialize):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(ngram_jaccard, "materialize", kept)
    rows = [(1, "a  B\tc "), (2, "A b C"), (3, " \n"), (4, None), (5, "")]
    members, links = ngram_jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.id, r.rep) for r in members.collect()} == {(1, 1), (2, 1)} and links.count() == 0
    assert plans["ng-texts"].count("md5") == 1 and plans["ng-texts"].count("[\\x20") == 1
