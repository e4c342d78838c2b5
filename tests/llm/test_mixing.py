"""Pareto mixing against a plain model of its rules."""

import re

import pytest

from corpusloom.llm.mixing import mix_sources, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by sharing the excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(most * sizes[s] for s in fixed)
        target = {s: most * sizes[s] if s in fixed else left * w[s] / sum(w[x] for x in free) for s in order}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        fixed |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 900, "c": 5000}, {"a": 1, "b": 1, "c": 1, "d": 1, "e": 2000, None: 30}, {"a": 7}, {"a": 0, "b": 5}, {f"s{i}": (i * 37) % 101 for i in range(40)}])
def test_targets_are_those_of_sharing_again(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_meets_targets_and_limits(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 60)), f"s{i % 5}" if i % 11 else None, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")  # a column by the name of an output
    got = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r[0]: r[2] for r in rows}
    sums, target = {}, {}
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r.doc_id][1]))
        assert r.taken <= 3 * r["size"] and r.taken % r["size"] == 0
        sums[source[r.doc_id]] = sums.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(sums[s] - target[s]) <= 3 for s in sums)


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "one two", "a"), (4, "x " * 20000, None), (4, "x " * 20000, None), (5, "a b", ""), (5, "a b", "")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 0 for r in got if r.doc_id in (1, 2))
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_importance_gives_unequal_chances(spark):
    rows = [(i, "w w w w", "a" if i < 400 else "b", 1.0 + 3.0 * (i % 2)) for i in range(1600)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, worth double"), weights=(1, 9), importance="worth").collect()
    heavy, light = (sum(r.copies for r in got if r.doc_id < 400 and r.doc_id % 2 == k) for k in (1, 0))
    assert 2 < heavy / max(1, light) < 8


def test_words_expected_meet_the_target_though_copies_are_cut_off(spark):
    """Very uneven importances: shared again among those that are not cut off, against a plain loop."""
    from corpusloom.llm.mixing import expected_copies

    importance = {0.0: 50, 1.0: 300, 2.0: 40, 64.0: 30, 1000.0: 5}
    for target in (10.0, 300.0, 900.0, 1124.9, 1125.0):
        rows = spark.createDataFrame([("a", False, w, n) for w, n in importance.items()], "of string, no_source boolean, importance double, size long")
        targets = spark.createDataFrame([("a", False, target)], "of string, no_source boolean, target double")
        got = {r.importance: r.expected for r in expected_copies(rows, targets, 3).collect()}
        capped = set()
        while True:
            free = {w: n for w, n in importance.items() if w and w not in capped}
            level = (target - 3 * sum(importance[w] for w in capped)) / sum(w * n for w, n in free.items()) if free else 0
            more = {w for w in free if level * w >= 3}
            if not more:
                break
            capped |= more
        assert got == {w: pytest.approx(3.0 if w in capped else level * w) for w in importance if w}
        assert sum(got[w] * importance[w] for w in got) == pytest.approx(target)
    docs = spark.createDataFrame([(i, "w " * (600 if i % 2 else 20), "a" if i < 1000 else "b") for i in range(4000)], "doc_id long, text string, source string")
    got = mix_sources(docs, weights=(1, 15)).where("doc_id < 1000").collect()
    taken = [sum(r.copies for r in got if r.doc_id % 2 == k) for k in (1, 0)]
    assert 2 < taken[0] / taken[1] < 4.5  # three times the chance of a short one
    assert abs(sum(r.taken for r in got) - got[0].target) <= 600
