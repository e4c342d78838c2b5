"""Scores of trained models against plain loops, and columns beside nulls."""

import math
import random
import zlib
from dataclasses import replace

import numpy as np
import pytest

from corpusloom.llm import pii, quality, toxicity
from corpusloom.llm.op10 import COLUMNS, redact_rows
from corpusloom.llm.scoring import map_texts, score_texts

BIG = 9007199254740993
MASK = (1 << 64) - 1


def rows_of(word, buckets):
    """The bucket of the word and of each of its 3- to 5-grams, one character at a time."""
    points = [ord(c) for c in f"<{word}>"]
    codes = [sum(p * pow(1099511628211, i + 1, 1 << 64) for i, p in enumerate(points)) & MASK]
    for n in (3, 4, 5):
        for at in range(len(points) - n + 1):
            h = n
            for p in points[at : at + n]:
                h = (h * 1000003 + p) & MASK
            codes.append(h)
    return [(((h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & MASK) >> 32) % buckets for h in codes]


def test_toxicity_scores_equal_a_plain_loop():
    rng = random.Random(11)
    vocabulary = ["word", "the", "it's", "naïve", "x" * 300, "a", "vequor", "beta"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 200))) for _ in range(60)]
    labels = [int("vequor vequor" in t) for t in texts]
    model = toxicity.train(texts, labels)
    for text in texts + [None, "", "..."]:
        found = toxicity._WORD.findall((text or "").lower())
        words = [w for i, w in enumerate(found) if not i or found[i - 1] != w]
        gains = []
        for w in words:
            rows = rows_of(w, model.settings.buckets)
            gains.append(sum(float(model.gain[r]) for r in rows) / len(rows))
        segments = [gains[i : i + 40] for i in range(0, len(gains), 40)]
        z = max((sum(s) / max(len(s), 20) for s in segments), default=None)
        z = min(model.bias, -2.2) if z is None else z + model.bias
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_quality_scores_equal_a_plain_loop():
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["Word", "it", "BUY!!", "a1b22", "é", "y" * 500, "no."], k=rng.randrange(1, 60))) for _ in range(60)]
    labels = [int("BUY!!" not in t) for t in texts]
    model = quality.train(texts, labels)
    top = 64 - model.bits
    for text in texts + [None, "", " "]:
        words = [w for w in (text or "").replace("\t", " ").split(" ") if w]
        low = [zlib.crc32(w.lower().encode()) for w in words]
        form = [zlib.crc32(b"=") if i and low[i] == low[i - 1] else zlib.crc32(quality.shape(w).encode()) for i, w in enumerate(words)]
        z = model.bias
        for kind, codes in enumerate((low, form)):
            ones = [c + ((kind + 1) << 33) for c in codes]
            twos = [(a * 1000003 + b + ((kind + 3) << 33)) & MASK for a, b in zip(ones, ones[1:])]
            for grams in (ones, twos):
                if grams:
                    z += quality.SCALE * sum(float(model.weights[((g * 0x9E3779B97F4A7C15) & MASK) >> top]) for g in grams) / len(grams)
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-4)
    assert quality.shape("ab1" * 40) != quality.shape("ab1" * 40 + "!")  # no prefix decides


def test_ids_beside_nulls_keep_their_value(spark):
    rows = [(BIG, "a@b.cd", BIG, 6), (None, None, None, None), (BIG, "x" * 50_000, 7, 50_000), (BIG, "x" * 50_000, 7, 50_000), (3, "", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `text of doc_id` long, n_chars int").coalesce(1)
    scored = score_texts(docs, toxicity.train([], []), keep=["doc_id", "text of doc_id"]).collect()
    assert [(r.doc_id, r[1]) for r in scored] == [(r[0], r[2]) for r in rows]
    masked = redact_rows(docs.withColumn("masked", docs.doc_id), pii.train([]))
    assert masked.columns == [*docs.columns, "masked"] and dict(masked.dtypes)["n_chars"] == "int"
    assert [tuple(r) for r in masked.collect()] == [(BIG, "[EMAIL]", BIG, 7, BIG), *((*r, r[0]) for r in rows[1:])]
    assert score_texts(docs.limit(0), quality.train([], [])).count() == 0


def test_personal_data_of_odd_numbers(spark):
    text = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(text) == [("ip", 0, 5006)]
    assert pii.base_spans("0.0.0.000") == [("ip", 0, 9)] and pii.base_spans("256.1.1.1") == []
    model = pii.train(["mail a1@b.cd or 10.0.0.1 now"] * 3)
    assert ("ip", 0, 5006) in pii.find(text, model)[1]
    assert pii.find("12 " * 40_000, model)[0] == []
    assert set(COLUMNS.values()) <= {"long", "string"}


def test_trained_skip_weights_change_a_label():
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        mail, number = f"{rng.choice('abcdefgh')}{rng.randrange(999)}@ex{rng.randrange(99)}.com", rng.randrange(10**6)
        texts.append(f"mail {mail} then words and more words {number} for {number} it. write {mail} again, or code{rng.randrange(99)}x")
    model = pii.train(texts)
    assert model.skip[1, 1] > 0.5 > 0 > model.skip[0, 1]  # learnt: doubles have one label
    text = "mail qq7@local then the words and then qq7@local stays"  # after "mail" it is an address, after "then" hardly
    loose = replace(model, skip=np.zeros_like(model.skip))
    assert pii.find(text, model, threshold=0.5)[1] == [("email", 5, 14), ("email", 39, 48)]
    assert pii.find(text, loose, threshold=0.5)[1] == [("email", 5, 14)]
    # Messages taken in parts are the same.
    _, tokens, where, edges = pii.lattice(text * 20)
    unary = model.potentials(tokens, where)[0]
    assert np.allclose(model.marginals(unary, edges)[0], model.marginals(unary, edges, part=3)[0])


def test_added_columns_replace_those_of_their_name(spark):
    docs = spark.createDataFrame([(1, "a", 2), (2, None, 3)], "doc_id long, text string, LENGTH long")
    got = map_texts(docs, "text", docs.columns, {"length": "long"}, lambda: lambda ts: [[len(t or "") for t in ts]])
    assert got.columns == ["doc_id", "text", "length"] and sorted(tuple(r) for r in got.collect()) == [(1, "a", 1), (2, None, 0)]
