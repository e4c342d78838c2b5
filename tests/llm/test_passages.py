"""Repeated passages and benchmark passages against what was planted."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm.chaining import Fenwick, Runs, Settings, chains, common, covering_runs, linked, matched_runs, repeated_passages, seeds
from corpusloom.llm.decontamination import Benchmark, find_leaks, item_codes, within
from corpusloom.llm.tokens import Codes, shingles

DOCS = "doc_id long, text string"


def words(rng, n, prefix="w"):
    return [f"{prefix}{rng.randrange(10**6)}" for _ in range(n)]


def test_seeds_of_a_shared_run_agree():
    rng, codes_of = random.Random(1), Codes()
    run = words(rng, 13)
    a, b = (codes_of.of(" ".join(words(rng, 40) + run + words(rng, 40))) for _ in range(2))
    assert set(shingles(a, 6)[seeds(a, 6, 8)].tolist()) & set(shingles(b, 6)[seeds(b, 6, 8)].tolist())
    assert len(seeds(codes_of.of("a b"), 6, 8)) == 0 and len(seeds(codes_of.of("a b c d e f"), 6, 8)) == 1


def test_codes_of_runs_are_those_of_their_words():
    rng = random.Random(14)
    for n in (3, 50, 4000):
        codes = Codes().of(" ".join(words(rng, n // 3)) + " " + " ".join(f"w{k % 7}" for k in range(n - n // 3)))
        got = Runs(codes).at(np.arange(len(codes)), 5)
        seen = {}
        for at in range(len(codes) - 4):
            assert got[at] and seen.setdefault(codes[at : at + 5].tobytes(), got[at]) == got[at]
        assert len(set(seen.values())) == len(seen) and not got[max(0, len(codes) - 4) :].any()


def test_fenwick_gives_the_best_before():
    rng = random.Random(2)
    tree, values = Fenwick(50), [(0.0, -1)] * 50
    for k in range(300):
        i, v = rng.randrange(50), (rng.random() * 10, k)
        tree.put(i, v)
        values[i] = max(values[i], v)
        j = rng.randrange(51)
        assert tree.top(j) == max(values[:j], default=(0.0, -1))


def test_chains_keep_order_and_are_cut_at_gaps():
    s = Settings()
    line = [(10 * i, 1000 + 10 * i) for i in range(20)]
    got = chains([*line, (55, 3), (57, 2000)], s)
    assert got[0] == line
    far = [(500 + 10 * i, 2000 + 10 * i) for i in range(5)]
    assert line in chains(line + far, s) and far in chains(line + far, s)
    assert common([1, 2, 3, 4], __import__("numpy").array([2, 9, 4])) == 2


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(3)
    exact, fuzzy = words(rng, 51), words(rng, 120)
    rows = [(i, " ".join(words(rng, 150))) for i in range(40)]
    for k, i in enumerate(range(40, 60)):
        body = words(rng, 80) + exact + words(rng, 60)
        if k % 2:
            edited = [w if rng.random() > 0.06 else f"z{rng.randrange(10**6)}" for w in fuzzy]
            body += edited + words(rng, 30)
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, DOCS).withColumn("seed", F.lit(0)).withColumn("pos", F.lit("x"))
    found = repeated_passages(docs).collect()
    assert {r.doc_id for r in found} | {r.other_id for r in found} == set(range(40, 60))
    assert len({r.doc_id for r in found if r.n_words > 80} & set(range(43, 60, 2))) >= 8  # of 9, in which two texts differ in every eighth word
    text = dict(rows)
    for r in found:
        if r.identity == 1.0:
            assert text[r.doc_id].split()[r.start_word : r.end_word] == text[r.other_id].split()[r.other_start : r.other_end]


def covered(found):
    """Words of each document that lie in a passage found, in either role."""
    out = {}
    for r in found:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        out.setdefault(r.other_id, set()).update(range(r.other_start, r.other_end))
    return out


def test_hot_seeds_over_many_partitions(spark):
    rng = random.Random(4)
    shared = words(rng, 70)
    rows = [(i, " ".join(words(rng, 20) + shared + words(rng, 20))) for i in range(300)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")  # a seed's rows are cut across partitions
    try:
        found = repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert set(covered(found)) == set(range(300)) and all(set(range(20, 90)) <= c for c in covered(found).values())
    assert len(found) < 300 * 20  # not all pairs


def test_rows_are_linked_with_the_row_before_whatever_the_batches():
    rng = random.Random(8)
    rows = sorted((rng.randrange(4), rng.randrange(3), rng.randrange(2), rng.randrange(5), i) for i in range(200))
    names = ["seed", "near", "far", "doc_id", "at"]
    want = set()
    for i, r in enumerate(rows):
        j = i - 1
        while j >= 0 and rows[j][0] == r[0] and rows[j][3] == r[3]:
            j -= 1
        if j >= 0 and rows[j][0] == r[0]:
            want.add((r[3], r[4], rows[j][3], rows[j][4]))
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + size])], names=names) for at in range(0, 200, size)]
        got = [x for b in linked(iter(batches), 3, "far") for x in b.to_pylist()]
        assert {(x["doc_id"], x["at"], x["other_id"], x["other_at"]) for x in got if x["edge"] < 0} == want
        assert [(x["edge"], x["at"]) for x in got if x["edge"] >= 0] == [(6, rows[0][4]), (7, rows[-1][4])]
    assert list(linked(iter([]), 0, "far")) == []


def test_no_passage_is_lost_to_documents_that_quote_a_part(spark):
    rng = random.Random(9)
    shared = words(rng, 120)
    rows = [(100, " ".join(words(rng, 60) + shared + words(rng, 60))), (300, " ".join(words(rng, 50) + shared + words(rng, 70)))]
    for k in range(14):
        at = rng.randrange(90)
        rows.append((50 + 20 * k, " ".join(words(rng, 40) + shared[at : at + 30] + words(rng, 40))))
    found = repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.doc_id, r.other_id, r.n_words, r.start_word, r.other_start) for r in found] == [(300, 100, 120, 50, 60)]


def test_overlapping_quotes_against_all_pairs(spark):
    rng = random.Random(10)
    stock = [words(rng, 400) for _ in range(3)]
    texts = {}
    for i in range(200):
        body = words(rng, rng.randrange(30))
        for _ in range(rng.randrange(1, 4)):
            line, at = rng.choice(stock), rng.randrange(340)
            body += line[at : at + rng.randrange(20, 150)] + words(rng, rng.randrange(5, 30))
        texts[i] = body
    found = repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], DOCS)).collect()
    got, sure = covered(found), 57  # 50 words and what the choice of seeds may leave before the first one
    holders = {}
    for i, t in texts.items():
        for at in range(len(t) - sure + 1):
            holders.setdefault(tuple(t[at : at + sure]), []).append((i, at))
    lost = total = 0
    for places in holders.values():
        if len({i for i, _ in places}) > 1:
            for i, at in places:
                total += 1
                lost += not set(range(at + 7, at + sure - 7)) <= got.get(i, set())
    assert total > 5000 and lost == 0
    assert all(r.identity >= 0.75 and r.n_words >= 50 for r in found)


def test_texts_that_repeat_inside(spark):
    rng = random.Random(11)
    line = words(rng, 30)
    rows = [(i, " ".join(line * 5)) for i in (7436, 8617, 8748)] + [(1, " ".join(words(rng, 150)))]
    got = covered(repeated_passages(spark.createDataFrame(rows, DOCS)).collect())
    assert set(got) == {7436, 8617, 8748} and all(len(c) == 150 for c in got.values())


def test_fuzzy_passages(spark):
    """Pairs of texts with one passage of some words, of which some are changed at random places."""
    rng, rows, n = random.Random(12), [], 100
    kinds = [(52, 4), (60, 6), (100, 15), (100, 20)]
    for k, (size, changed) in enumerate(kinds):
        for i in range(n):
            passage = words(rng, size)
            other = list(passage)
            for at in rng.sample(range(size), changed):
                other[at] = words(rng, 1, "z")[0]
            rows += [(k * 1000 + 2 * i + j, " ".join(words(rng, 60) + p + words(rng, 60))) for j, p in enumerate((passage, other))]
    found = {r.other_id for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    counts = [sum(k * 1000 <= i < k * 1000 + 1000 for i in found) for k in range(len(kinds))]
    print("fuzzy passages found of", n, dict(zip(kinds, counts)))
    assert all(c >= least for c, least in zip(counts, (90, 90, 90, 75)))


def test_passages_at_the_edges(spark):
    long = " ".join(words(random.Random(5), 20_000))
    rows = [(1, None), (2, ""), (3, "a b c"), (None, long), (4, long), (5, long), (5, long), (6, "x " * 3000)]
    found = repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(5, 4)} and max(r.n_words for r in found) == 20_000
    assert repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(6)
    b = Benchmark.build([(i, " ".join(words(rng, 30))) for i in range(20)], radius=19)
    group = b.lengths[30]
    for _ in range(300):
        n, flips = rng.randrange(20), rng.randrange(20)
        near = int(b.prints[n])
        for bit in rng.sample(range(64), flips):
            near ^= 1 << bit
        whose, which = group.near(np.array([0, near], dtype=np.uint64))
        assert n in group.items[which[whose == 1]]
    assert len(list(within(0, 2))) == 1 + 16 + 120


def test_leaks(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.randrange(8, 60)))) for i in range(30)] + [(90, "just two"), (91, None), (92, ""), (3, None)]
    rows = [(i, " ".join(words(rng, 300))) for i in range(100)]
    for i in range(30):
        rows.append((100 + i, " ".join(words(rng, 50)) + " " + items[i][1].upper() + " , " + " ".join(words(rng, 50))))
        w = items[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(words(rng, 50) + w + words(rng, 50))))
    rows += [(300, "has just two here"), (301, "just two"), (302, None), (303, ""), (304, "x")]
    docs, bench = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in find_leaks(docs, bench).collect()}
    assert {(100 + i, i) for i in range(30)} <= set(found) and {(300, 90), (301, 90)} <= set(found)
    assert all(found[(100 + i, i)].similarity == 1.0 for i in range(30))
    long = {200 + i for i in range(30) if len(items[i][1].split()) >= 20}
    assert len(long & {d for d, _ in found}) >= 0.9 * len(long)
    assert not [d for d, _ in found if d < 100 or d > 301]
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench, most_items=7).collect()} == set(found)
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0


def test_texts_that_repeat_inside_are_compared_whole(spark):
    rng = random.Random(8)
    line, stock = " ".join(words(rng, 30)), [" ".join(words(rng, 20)) for _ in range(9)]
    rows = [(i, " ".join([line] * 5)) for i in (1, 2, 3)] + [(9, "same word " * 2000), (10, "same word " * 1500)]
    # Each stock line is shared with other documents before and between those that share a passage of three.
    for at, lines in enumerate((stock[:3], stock[3:6], stock[6:])):
        for k, x in enumerate(lines):
            rows += [(100 * at + 20 + k, " ".join([*words(rng, 60), x])), (100 * at + 50 + k, " ".join([*words(rng, 60), x]))]
        rows += [(100 * at + n, " ".join([*words(rng, 40), *lines, *words(rng, 40)])) for n in (40, 70)]
    found = repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    whole = {(r.doc_id, r.other_id) for r in found if r.n_words == 150 and r.identity == 1.0}
    assert {d for d, _ in whole} == {2, 3}
    assert max(r.n_words for r in found if r.doc_id == 10) == 3000
    assert {(r.doc_id, r.other_id) for r in found if r.doc_id > 10} == {(100 * at + 70, 100 * at + 40) for at in range(3)}


def test_covering_runs_miss_no_word_of_a_common_run():
    rng = random.Random(9)
    for _ in range(60):
        a, b = (np.array([rng.randrange(2) for _ in range(rng.randrange(3, 60))], dtype="<u4") for _ in range(2))
        cover = lambda runs, side: {r[side] + t for r in runs for t in range(r[2])}
        every, few = matched_runs(a, b, 3, dense=10**6), covering_runs(a, b, 3)
        assert all((a[x : x + n] == b[y : y + n]).all() for x, y, n in every + few)
        assert cover(every, 0) == cover(few, 0) and cover(every, 1) == cover(few, 1)


def all_windows(b, items, codes):
    """Best similarity of each item over all windows of its length, by sets and plain sums."""
    codes_of, best = Codes(), {}
    df = {}
    for _, text in items:
        for x in set(item_codes(codes_of.of(text), b.k).tolist()):
            df[x] = df.get(x, 0) + 1
    weight = lambda x: 1 + math.log(len(items) / df.get(x, 1))
    for i, text in items:
        own = codes_of.of(text)
        mine = set(shingles(own, b.k).tolist())
        for at in range(len(codes) - len(own) + 1):
            window = set(shingles(codes[at : at + len(own)], b.k).tolist())
            best[i] = max(best.get(i, 0.0), sum(map(weight, window & mine)) / sum(map(weight, window | mine)))
    return best


def test_every_window_that_reaches_the_similarity_is_found():
    rng, codes_of = random.Random(10), Codes()
    stock = words(rng, 60)  # items have words in common
    items = [(i, " ".join(rng.sample(stock, 10) + words(rng, rng.choice((10, 20))))) for i in range(40)]
    b, reached, kept = Benchmark.build(items), [0, 0], [0, 0]
    for n, (_, text) in enumerate(items):
        for k, rate in enumerate((0.1, 0.15)):
            copy = [w if rng.random() > rate else f"z{rng.randrange(10**6)}" for w in text.split()]
            codes = codes_of.of(" ".join(words(rng, 20) + copy + words(rng, 20)))
            best = all_windows(b, items, codes)
            found = {b.ids[i]: similarity for i, _, _, _, similarity in b.search(codes)}
            assert set(found) == {i for i, x in best.items() if x >= b.threshold} and all(abs(found[i] - best[i]) < 1e-5 for i in found)
            reached[k] += best[n] >= b.threshold
            kept[k] += n in found
    assert kept == reached and min(reached) >= 36  # of 40


def test_candidates_come_from_the_multi_index():
    rng, codes_of = random.Random(13), Codes()
    text = " ".join(words(rng, 30))
    b = Benchmark.build([(1, text)])
    assert [f[0] for f in b.search(codes_of.of(text))] == [0]
    b.lengths[30].begins = np.zeros_like(b.lengths[30].begins)
    assert b.search(codes_of.of(text)) == []


def test_leaks_of_odd_rows(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(big, "one two three four five"), (None, "one two three four five"), (None, None), (big, "x " * 50_000 + "one two three four five")], DOCS).coalesce(1)
    bench = spark.createDataFrame([(big, "one two three four five"), (big, "one two three four five"), (None, "x"), (4, "One"), (5, "...")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start_word) for r in find_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(d, i, at) for d, at in ((big, 0), (None, 0), (big, 50_000)) for i in (big, 4)], key=str)


def test_fuzzy_passages_are_not_cut_by_the_span_of_their_seeds(spark):
    rng = random.Random(11)
    rows = []
    for n in range(60):
        core = words(rng, 60)
        other = list(core)
        for i in rng.sample(range(60), 12):
            other[i] = f"z{rng.randrange(10**6)}"
        rows += [(2 * n, " ".join(words(rng, 60) + core + words(rng, 60))), (2 * n + 1, " ".join(words(rng, 60) + other + words(rng, 60)))]
    found = repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.other_id == r.doc_id - 1 and r.identity >= 0.75 and r.n_words >= 50 for r in found)
    assert len({r.doc_id for r in found}) >= 50  # the others have no seed in common


def test_variants_of_a_passage_meet_whatever_lies_between(spark):
    rng = random.Random(21)
    core = words(rng, 6)  # the only run of six words that the two texts have in common
    left, right = words(rng, 45), words(rng, 45)

    def variant(turn):
        edit = lambda part: [f"e{rng.randrange(10**6)}" if n % 8 == turn else w for n, w in enumerate(part)]
        return edit(left) + core + edit(right)

    texts = {1: variant(0), 900: variant(4)}
    for i in range(100, 140):  # texts with the core alone: in order of what follows, some lie between
        texts[i] = words(rng, 60) + core + words(rng, 60)
    found = repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], DOCS)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(900, 1)}


def test_places_of_a_seed_are_compared_without_trying_all_pairs(monkeypatch):
    from corpusloom.llm.chaining import Meetings, nth, passages, sides

    rng, s, codes_of, tried = random.Random(22), Settings(), Codes(), []
    core, stock = words(rng, 6), words(rng, 5000)
    common_first = [1 / (n + 1) for n in range(len(stock))]
    texts = [[rng.choices(stock, common_first, k=100), rng.choices(stock, common_first, k=100)] for _ in range(200)]
    for n in range(0, 60, 2):  # a text and a variant of it near the seed
        for side, (own, near) in enumerate(((58, 100), (0, 42))):
            part = [w if rng.random() > 0.15 else f"e{rng.randrange(10**6)}" for w in texts[n][side][own:near]]
            texts[n + 1][side][own:near] = part
    for n in range(60, 90):  # a few words over and over
        texts[n] = [[w for w in rng.sample(stock[:3], 2) for _ in range(50)] for _ in range(2)]
    codes = [(codes_of.of(" ".join(left + core + right)) >> np.uint64(32)).astype("<u4") for left, right in texts]
    around = np.concatenate([sides(c, np.array([100]), s.k, s.margin) for c in codes])
    classes = np.array([0 if n >= 150 else n // 3 for n in range(200)])
    able = Meetings._able
    monkeypatch.setattr(Meetings, "_able", lambda self, i, j, *rest: (tried.append(np.size(j)), able(self, i, j, *rest))[1])
    order = np.concatenate([nth(around[:, : s.margin]), nth(around[:, s.margin :])], axis=1)
    want = set()
    for i in range(200):
        for j in range(i):
            if classes[i] != classes[j] and any(p <= 100 and x >= 106 and q <= 100 and y >= 106 for p, x, q, y, _ in passages(codes[i], codes[j], s)):
                want.add((j, i))
    every, half = np.arange(200), np.arange(100)
    meetings = Meetings(around, order, s)
    found = [(int(min(i, j)), int(max(i, j))) for x, y in meetings.pairs(every, every, classes) for i, j in zip(x, y)]
    assert len(want) > 30 and want <= set(found) and len(found) == len(set(found))
    assert all(classes[i] != classes[j] for i, j in found)
    assert sum(tried) < 200 * 199 / 4  # half of all pairs, though texts of the same few words are tried in unions, too
    halves = {(int(i), int(j)) for x, y in meetings.pairs(half, half + 100, classes) for i, j in zip(x, y)}
    assert halves == {(i, j) for i, j in found if i < 100 <= j}
