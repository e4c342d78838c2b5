"""Text functions, chunking and packing against plain models of their rules."""

import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import fts, text
from corpusloom.operators import bm25, chunking, packing

ALPHABET = ["a", "bb", ".", "!", " ", "\n", " ", "\x1c", "é", "　", ". ", "end. "]


def entries(spark, rows, columns="idx long, id string, title string, text string, source string, metadata string"):
    df = spark.createDataFrame(rows, columns)
    return df.withColumn("metadata", F.parse_json("metadata"))


def test_words_and_sentences_are_pythons(spark):
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(30))) for _ in range(300)] + ["", "Ends. ", "One. Two! Three?"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", text.words("t").alias("w"), text.sentences("t").alias("s")).collect()
    for r in got:
        assert r.w == texts[r.i].split()
        assert r.s == re.split(r"(?<=[.!?])\s+", texts[r.i])


@given(st.integers(0, 60), st.integers(1, 20), st.integers(0, 19))
@settings(max_examples=200, deadline=None)
def test_window_count(words, size, overlap):
    if overlap >= size:
        return
    starts, at = [0], 0
    while at + size < words:
        at += size - overlap
        starts.append(at)
    assert len(starts) == max(-(-(words - size) // (size - overlap)) + 1, 1)


def test_word_windows(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(25)),), ("w0 w1",), ("",)], "t string")
    got = [r.c for r in df.select(chunking.word_windows("t", 10, 3).alias("c")).collect()]
    assert [len(c.split()) for c in got[0]] == [10, 10, 10, 4]
    assert got[0][1].split()[0] == "w7" and got[1] == ["w0 w1"] and got[2] == [""]
    with pytest.raises(ValueError):
        chunking.word_windows("t", 5, 5)


def test_sentence_fold_rules():
    parts = [f"{'w ' * 39}w{i}." for i in range(6)]  # 40 words each
    got = chunking.fold_sentences(parts, 100, 45)
    assert got[0].split() == " ".join(parts[:2]).split() and got[1].startswith(parts[1])
    assert chunking.fold_sentences(["w " * 500 + "."], 100, 10) == ["w " * 500 + "."]  # never split
    tail = chunking.fold_sentences(["a " * 99 + "a.", "b c."], 100, 0)
    assert len(tail) == 1 and tail[0].endswith("b c.")


def test_chunk_entries_carry_lineage(spark):
    df = entries(spark, [(0, "a", "T", " ".join(f"Word{i}." for i in range(600)), "s", '{"k": 1, "parent_id": "old"}'), (1, "b", "", "short", "s", "{}"), (2, "c", None, "w " * 600, None, "{}"), (3, "d", "N", None, None, "{}")])
    got = chunking.chunk_entries(df, 200, 20).orderBy("idx", "chunk_index").withColumn("m", F.to_json("metadata")).collect()
    a = [r for r in got if r.parent_id == "a"]
    assert a[0].id == "a__chunk_0" and a[0].title == f"T (part 1/{len(a)})" and a[0].total_chunks == len(a)
    assert '"k":1' in a[0].m and '"parent_id":"a"' in a[0].m and "old" not in a[0].m
    assert next(r for r in got if r.id == "b").parent_id is None
    assert all(r.title is None for r in got if r.parent_id == "c")
    assert any(r.id == "d" for r in got)


def test_multiscale_ids(spark):
    df = entries(spark, [(0, "a", "T", " ".join(f"W{i}." for i in range(300)), "s", "{}"), (1, "b", "T", "short", "s", "{}"), (2, "b", "T", "short two", "s", "{}")])
    got = {r.id: r for r in chunking.multiscale_chunk_entries(df, [200, 500], 20).collect()}
    assert got["b"].text == "short" and got["a__s500"].parent_id is None and got["a__s200_chunk_0"].parent_id == "a"
    assert got["a__s200_chunk_0"].title.startswith("T (s200 part 1/")


def packed(lengths, most):
    out, batch, used, holds = [], 0, 0, False
    for n in lengths:
        if holds and (n > most or used + n > most):
            batch, used, holds = batch + 1, 0, False
        out.append(batch)
        if n > most:
            batch += 1
        else:
            used, holds = used + n, True
    return out


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 20, 50, 100, 101, 150]) for _ in range(200)]
    got = packing.assign_batches(spark.createDataFrame(list(enumerate(lengths)), "idx long, length long").repartition(5), 100).orderBy("idx").collect()
    assert [r.batch_id for r in got] == packed(lengths, 100)
    assert packing.assign_batches(spark.createDataFrame([], "idx long, length long")).count() == 0


def test_query_is_sanitised():
    assert fts.safe_query('foo "bar" AND b*z or ( OR') == '"foo" "bar" AND "bz" "or" OR'
    assert fts.safe_query("") == ""


@pytest.mark.parametrize("query", ["a AND", "OR a", "a OR OR b", "NOT a", "a AND NOT b"])
def test_wrong_syntax(query):
    with pytest.raises(fts.QuerySyntaxError):
        fts.parse(fts.safe_query(query), fts.plain)


WORDS = ["run", "running", "café", "Cafe", "state", "of", "the", "art", "generation", "general", "x-ray", "don't", "ties", "Übung", "日本語", "straße"]
ASKED = ["run", "running cafe", "state-of-the-art", "run OR tie", "run AND NOT", "general NOT run", "cafe OR run ties", "x-ray NOT the NOT of", "- run", "-", "run NOT -", "run AND -", "src OR run", "run run", "日本語 OR straße", "state of OR the art", "(run) OR \"ties\"", "a OR b AND generation"]


def test_bm25_agrees_with_an_independent_engine(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(5))), " ".join(rng.choices(WORDS, k=rng.randrange(12))) + (" state of the art" if i % 9 == 0 else ""), rng.choice(["src", "other", None])) for i in range(80)]
    other = sqlite3.connect(":memory:")
    other.execute("CREATE VIRTUAL TABLE f USING fts5(title, text, source, tokenize='porter unicode61')")
    for i, title, body, source in rows:
        other.execute("INSERT INTO f(title, text, source, rowid) VALUES (:t, :x, :s, :i)", {"i": i, "t": title, "x": body, "s": source or ""})
    index = bm25.build(spark.createDataFrame(rows, "idx long, title string, text string, source string"))
    index.postings.cache()
    for query in ASKED:
        try:
            want = other.execute("SELECT rowid, -bm25(f, 10.0, 1.0, 0.0) FROM f WHERE f MATCH ? ORDER BY bm25(f, 10.0, 1.0, 0.0), rowid LIMIT 200", (fts.safe_query(query),)).fetchall()
        except sqlite3.OperationalError:
            want = []
        got = [(r.idx, r.bm25) for r in bm25.search(index, query).collect()]
        assert {i for i, _ in got} == {i for i, _ in want}, query
        scores = dict(want)
        assert all(abs(s - scores[i]) < 1e-9 for i, s in got), query
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    index.postings.unpersist()
