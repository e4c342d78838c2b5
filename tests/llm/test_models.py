"""Trained operators: accuracy on texts that were not learnt from, and rows at the edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pii, quality, toxicity, url_filter
from corpusloom.llm.scoring import labelled_sample, score_texts
from corpusloom.llm.shared import held_out


def sentence(rng, n):
    return [rng.choice(["the", "of", "and", "rende", "thaton", "inger", "ounted", "heast"]) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n)]


def toxic_texts(rng, count, endings):
    out = []
    for k in range(count):
        w = sentence(rng, rng.randrange(30, 200))
        if k % 2:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "vequo" + rng.choice(endings))
        out.append((" ".join(w), k % 2))
    return out


def test_toxicity_knows_misspellings_it_never_saw():
    rng = random.Random(1)
    learnt, other = toxic_texts(rng, 300, ["r", "is", "que", "nt", "mo"]), toxic_texts(rng, 100, ["zzt", "lla", "bb", "ka"])
    model = toxicity.train([t for t, _ in learnt], [y for _, y in learnt])
    scores = model.scores([t for t, _ in other])
    y = np.array([y for _, y in other])
    above = (scores[y == 1][:, None] > scores[y == 0][None, :]).mean()  # the endings differ from all that were learnt
    assert scores[y == 1].mean() > scores[y == 0].mean() + 0.2 and above > 0.9
    known = model.scores([t for t, _ in learnt])
    assert ((known >= 0.5) == np.array([y for _, y in learnt])).mean() > 0.95
    assert np.isfinite(model.scores([None, "", "x" * 100_000, "word " * 50_000])).all()
    assert (model.scores(["the of"]) == model.scores(["the of"])).all()
    assert 0 < toxicity.train(["a", "b"], [0, 0]).scores(["a"])[0] < 0.5
    assert toxicity.train([], []).scores(["a"])[0] == pytest.approx(0.5)


def test_quality_knows_junk():
    rng = random.Random(2)
    rows = []
    for k in range(400):
        w = sentence(rng, rng.randrange(30, 200))
        junk = k % 4
        text = " ".join(w) + "." if junk else " ".join(x.upper() + "!!" for x in w) if k % 8 else " ".join(x for x in w[:10] for _ in range(20))
        rows.append((text, int(junk > 0)))
    model = quality.train([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    scores, y = model.scores([t for t, _ in rows[300:]]), np.array([y for _, y in rows[300:]])
    assert ((scores >= 0.3) == y).mean() > 0.95
    assert np.isfinite(model.scores([None, "", "x" * 100_000])).all()


def test_samples_and_scores(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 3 else None, "en") for i in range(40)], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 1)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", ~held_out(F.col("doc_id")), 20)
    assert len(sample) == 20 and sample["label"].sum() == 10
    import zlib

    assert all(zlib.crc32(str(i).encode()) % 5 for i in sample["doc_id"])
    got = score_texts(docs, toxicity.train([], []), score="score")
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 40
    assert score_texts(docs.limit(0), toxicity.train([], [])).count() == 0


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.org/es/1?x#y", "https://b.org", "x://COM/fr/9", "no scheme", None, "", "http://h.com?q=/de/", "a://b://c/d", "http://notexample.org/es/1", "http://example.org/es/", "http://m.example.org/en/17", "http://x.com/de/1"]
    from corpusloom.llm.op7 import RULES

    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, u string").select("i", "u", url_filter.host_of(F.col("u")).alias("h"), url_filter.path_of(F.col("u")).alias("p"))
    got = {r.i: r for r in df.withColumn("rule", url_filter.rule_of(F.col("h"), F.col("p"), RULES)).collect()}
    for i, u in enumerate(urls):
        assert (got[i].h, got[i].p) == url_filter.parts(u), u
    assert [got[i].rule for i in range(len(urls))] == ["example.org/es/", None, "com/fr/", None, None, None, None, None, "org/", "example.org/es/", "example.org/en/1", "com/de/"]


def labelled_urls(n, seed):
    """Two kinds of URLs: long ones with many digits and parameters on a few suffixes, and plain ones."""
    rng = random.Random(seed)
    urls, labels = [], []
    for k in range(n):
        name = "".join(rng.choices("abcdefghij", k=rng.randrange(5, 12)))
        if k % 2:
            urls.append(f"http://{name}{rng.randrange(10**5)}.{rng.choice(['biz', 'xyz', 'com'])}/{rng.randrange(10**6)}?" + "&".join(f"p{i}={rng.randrange(100)}" for i in range(rng.randrange(1, 5))))
        else:
            urls.append(f"https://{name}.{rng.choice(['org', 'com', 'net'])}/{'/'.join(rng.choices(['a', 'news', 'it'], k=rng.randrange(1, 4)))}")
        labels.append(k % 2)
    return urls, labels


def test_trees_tell_urls_apart():
    model = url_filter.train(*labelled_urls(1500, 1))
    urls, labels = labelled_urls(500, 2)
    scores = model.scores(urls)
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.97
    assert np.isfinite(model.scores([None, "", "://", "http://" + "a" * 50_000])).all()
    assert url_filter.train(["http://a.b/"], [0]).scores(["http://a.b/"])[0] < 0.5
    assert url_filter.train([], []).scores(["http://a.b/"])[0] == pytest.approx(0.5)
    # Each score against a walk down every tree, one node at a time.
    for url, score in zip(urls[:100] + [None], model.scores(urls[:100] + [None]), strict=True):
        x, z = url_filter.features(url, model.suffixes), model.base
        assert len(x) == len(url_filter.NAMES)
        for feature, cut, left, value in model.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] + (x[feature[at]] > cut[at])
            z += value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))
    long = ["http://" + "a" * 3000 + tail + ".com/" for tail in ("", "0123456789" * 20)]  # whole strings count
    assert url_filter.features(long[0], model.suffixes)[7] != url_filter.features(long[1], model.suffixes)[7]


def test_verdicts_by_rules_and_by_trees_that_learnt_from_them(spark):
    from corpusloom.llm.op7 import fitted, judge

    big = 9007199254740993
    urls = [f"http://a{i}.{e}/{p}/{i}" for i in range(60) for e, p in (("org", "x"), ("com", "fr"), ("com", "de"), ("net", "en"))]
    pages = spark.createDataFrame([(big + i, u, None) for i, u in enumerate([*urls, None, "odd", urls[0]])] + [(None, "http://b.com/de/", None)], "page_id long, url string, score string").coalesce(1)
    model = fitted(pages)
    got = {r.page_id: r for r in judge(pages, model).collect()}
    assert len(got) == len(urls) + 4 and got[None].verdict == "block"
    own = model.scores(urls)
    for i, u in enumerate(urls):
        rule = "org/" if ".org/" in u else "com/fr/" if "/fr/" in u else "com/de/" if "/de/" in u else None
        assert got[big + i].rule == rule and got[big + i].verdict == ("block" if (rule == "com/de/" if rule else own[i] >= 0.5) else "allow")
    labelled = spark.createDataFrame([(u, int(".net/" in u)) for u in urls], "url string, label int")
    assert {got.verdict for got in judge(pages.where("url LIKE '%.net/%'"), fitted(pages, labelled)).collect()} == {"block"}
    assert judge(pages.limit(0), fitted(pages.limit(0))).count() == 0


def test_patterns_against_plain_searches():
    import re

    def plain(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and pii.luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return out

    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x.y", ".", "1", "22", "4111 1111 1111 1111", "+1 (555) 010-9999", " ", "-", "+", "300.1.2.3", "10.0.0.1", "é", "00000.1.1.1", "\n"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans(None) == [] and pii.base_spans("") == [] and pii.base_spans("9" * 200_000) == []


def test_field_carries_labels_between_distant_doubles():
    rng = random.Random(4)
    texts = []
    for k in range(120):
        phone = f"+1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        texts.append(f"call {phone} or mail user{k}@example.com about item {rng.randrange(99)} at 10.0.{k}.{rng.randrange(255)} today")
    model = pii.train(texts)
    text = "mail joe.smith77@mail.example.com now " + "word " * 50 + "again 12 joe.smith77@mail.example.com"
    base, both = pii.find(text, model)
    assert len(base) == 2 and set(base) <= set(both)
    # A node with no evidence of its own follows the node that a skip edge ties it to; without the edge it doesn't.
    unary = np.zeros((2, model.labels))
    unary[0, 1] = 6.0
    tied, alone = model.marginals(unary, [(0, 1, True)])[0], model.marginals(unary, [])[0]
    assert tied[1, 1] > alone[1, 1]
    assert pii.find(None, model) == ([], []) and pii.find("", model) == ([], [])
    assert pii.find("no digits here", pii.train([])) == ([], [])


def test_masks(spark):
    from corpusloom.llm.op10 import redact_rows

    rows = [(1, "x a@b.cd y 10.0.0.1", 19), (2, None, None), (3, "", 0), (4, "plain", 5)]
    got = {r.doc_id: (r.text, r.n_chars) for r in redact_rows(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), pii.train([])).collect()}
    assert got == {1: ("x [EMAIL] y [IP]", 16), 2: (None, None), 3: ("", 0), 4: ("plain", 5)}
