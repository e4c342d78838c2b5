"""Ranking, files, merging, embedding and generation on small inputs."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.dates import freshness, with_parsed_dates
from corpusloom.operators import embed, generate, merge, neighbors
from corpusloom.plans.request import SearchRequest, search
from corpusloom.sources import files

AS_OF = datetime(2025, 1, 1)
SCHEMA = "idx long, id string, text string, source string, title string, date string, metadata string, embedding array<float>"


def corpus(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("metadata", F.parse_json("metadata"))
    return with_parsed_dates(df, AS_OF)


@pytest.fixture(scope="module")
def three(spark):
    return corpus(
        spark,
        [
            (0, "close", "a " * 400, "s1", "A", "2024-12-31", '{"parent_id": "p"}', [0.9, 0.1, 0.0, 0.0]),
            (1, "medium", "b", "s2", None, None, '{"parent_id": "p"}', [0.5, 0.5, 0.0, 0.0]),
            (2, "far", "c", None, "C", "2020-01-01", "{}", [0.0, 0.0, 1.0, 0.0]),
        ],
    ).cache()


def ids(df):
    return [r.id for r in df.orderBy("pos").collect()]


def ask(rows, **settings):
    return search(rows, SearchRequest("q", (1.0, 0.0, 0.0, 0.0), as_of=AS_OF, **settings))


def test_order_filters_and_dedup(three):
    assert ids(ask(three)) == ["close", "far"]  # medium shares a parent with close
    assert ids(ask(three, deduplicate=False)) == ["close", "medium", "far"]
    assert ids(ask(three, deduplicate=False, sources=frozenset({"s2"}))) == ["medium"]
    assert ids(ask(three, deduplicate=False, min_similarity=0.5)) == ["close", "medium"]
    assert ids(ask(three, deduplicate=False, since=datetime(2024, 1, 1))) == ["close"]
    assert ids(ask(three, deduplicate=False, sort_by="date")) == ["close", "far", "medium"]
    assert ids(ask(three, deduplicate=False, entry_filter=F.col("title").isNotNull())) == ["close", "far"]
    assert len(ask(three).orderBy("pos").first()["text"]) == 300


def test_post_processor_and_reranker(three):
    def back(query, rows, valid):
        return rows.withColumn("pos", -F.col("pos"))

    assert ids(ask(three, deduplicate=False, post_processors=(back,))) == ["far", "medium", "close"]
    got = ask(three, deduplicate=False, top_k=2, reranker=generate.rerank(lambda q, docs: [float(d.startswith("C")) for d in docs]), provenance=True)
    assert ids(got) == ["far", "close"]
    assert got.orderBy("pos").first()["provenance"]["rank_delta"] == 2


def test_plan_has_no_cartesian_product_and_takes_ordered(three):
    plan = ask(three)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "TakeOrderedAndProject" in plan and "WindowGroupLimit" in plan


def test_freshness(spark):
    df = corpus(spark, [(i, str(i), "t", s, None, d, "{}", [1.0]) for i, (s, d) in enumerate([("a", None), ("b", None), ("a", "2025-06-01"), ("a", "2024-01-02"), ("c", "2024-12-25")])])
    got = [round(r.f, 4) for r in df.orderBy("idx").select(freshness(AS_OF, {"b": None, "c": 7}).alias("f")).collect()]
    assert got == [0.5, 1.0, 1.0, 0.5, 0.5]
    with pytest.raises(ValueError):
        freshness(AS_OF, {"a": 0})


def test_dates(spark):
    cases = {"2024-03-05": datetime(2024, 3, 5), "2024-03-05T10:00:00+09:00": datetime(2024, 3, 5, 10), "March 5, 2024": datetime(2024, 3, 5), "2024": datetime(2024, 1, 1), "n.d.": None, "": None, None: None, "05/06/2024": datetime(2024, 5, 6), "20240115": datetime(2024, 1, 15), "2024-13-45": None}
    df = spark.createDataFrame([(k,) for k in cases], "date string")
    assert {r.date: r.date_parsed for r in with_parsed_dates(df, AS_OF).collect()} == cases


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    with open(path, "w") as f:
        f.write('{"id": "1", "text": "é", "extra": 5, "metadata": {"a": [1]}}\n\nnot json\n{"id": "2"}\n{"id": "", "text": "x"}\n{"id": 3, "text": "y", "metadata": null}\n')
    rows = files.read_jsonl(spark, path).orderBy("idx").collect()
    assert [(r.id, r.text, r.idx) for r in rows] == [("1", "é", 0), ("3", "y", 1)]
    assert files.write_jsonl(files.read_jsonl(spark, path), str(tmp_path / "out")) == 2
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {"id": "1", "text": "é", "metadata": {"a": [1]}} in lines and {"id": "3", "text": "y"} in lines


def test_index_round_trips(spark, three, tmp_path):
    meta = files.write_index(three, str(tmp_path / "i"), {"embedding_model": "m", "total_entries": 99})
    assert meta["total_entries"] == 3 and meta["embedding_dim"] == 4 and meta["sources"] == {"s1": 1, "s2": 1, "unknown": 1}
    assert files.read_metadata(spark, str(tmp_path / "i"))["embedding_model"] == "m"
    assert {r.id for r in files.read_index(spark, str(tmp_path / "i"), {"s1"}).collect()} == {"close"}
    assert files.read_index(spark, str(tmp_path / "i"), set()).count() == 0
    assert files.read_index(spark, str(tmp_path / "i"), {"unknown"}).count() == 0
    files.split_to_json(spark, str(tmp_path / "i"), str(tmp_path / "x.json"))
    assert [r.id for r in files.read_json_index(spark, str(tmp_path / "x.json")).orderBy("idx").collect()] == ["close", "medium", "far"]
    assert {r.name for r in files.disk_size(spark, str(tmp_path / "i")).collect()} >= {"metadata"}


def test_missing_vectors_become_zero(spark, tmp_path):
    path = str(tmp_path / "old.json")
    with open(path, "w") as f:
        json.dump({"metadata": {"embedding_dim": 3}, "entries": [{"id": "a", "text": "t"}, {"id": "b", "text": "u", "embedding": [1, 0, 0]}]}, f)
    files.json_to_split(spark, path, str(tmp_path / "s"))
    assert {r.id: list(r.embedding) for r in files.read_index(spark, str(tmp_path / "s")).collect()} == {"a": [0, 0, 0], "b": [1, 0, 0]}


def test_staleness(spark, three, tmp_path):
    os.makedirs(tmp_path / "src")
    for name in ("old_parsed.json", "new_parsed.json", "new_other.json"):
        (tmp_path / "src" / name).write_text("{}")
    assert files.check_staleness(spark, str(tmp_path / "none"), str(tmp_path / "src")) == []
    files.write_index(three, str(tmp_path / "i"))
    now = os.path.getmtime(tmp_path / "i" / "metadata")
    os.utime(tmp_path / "src" / "old_parsed.json", (now - 50, now - 50))
    for name in ("new_parsed.json", "new_other.json"):
        os.utime(tmp_path / "src" / name, (now + 50, now + 50))
    assert files.check_staleness(spark, str(tmp_path / "i"), str(tmp_path / "src")) == ["new_parsed.json"]


def test_merge(spark, three):
    again = three.where("id <> 'far'").withColumn("text", F.lit("other"))
    got = {r.id: r.text for r in merge.merge([three, again]).collect()}
    assert len(got) == 3 and got["medium"] == "b"
    assert {r.source: r.entries for r in merge.merged_source_counts([three, again]).collect()} == {"s1": 2, "s2": 2, "unknown": 1}
    assert merge.merged_metadata([{}, {"embedding_model": "a"}, {"embedding_model": "b"}], ["x", "y", "z"])[0]["embedding_model"] == "a"
    assert sorted(r.idx for r in merge.add_index(three, again).collect()) == [0, 1, 2, 3, 4]


def test_neighbours_stop_between_anchors(spark):
    graph = spark.createDataFrame([("k0", 0), ("k0", 10), ("k0", 11), ("k1", 1), ("k1", 12), ("k1", 10)], "key string, idx long")
    anchors = spark.createDataFrame([(0, 0), (1, 1)], "idx long, pos int")
    assert {r.idx for r in neighbors.expand(graph, anchors, max_neighbors=1).collect()} == {10, 11}
    assert {r.idx for r in neighbors.expand(graph, anchors, max_neighbors=3).collect()} == {10, 11, 12}


def test_cache_reuses_and_repeats_are_embedded_once(spark, tmp_path):
    rows = spark.createDataFrame([(0, "hello"), (1, "hello"), (2, "other words")], "idx long, text string")
    model = embed.model_of("test", dim=16, encode=embed.HashingEncoder(16))
    path = str(tmp_path / "cache")
    first = {r.idx: list(r.embedding) for r in embed.embed_entries(rows, model, path).collect()}
    assert first[0] == first[1] != first[2] and embed.load_cache(spark, path, 16).count() == 2

    def fails(texts):
        raise RuntimeError("should not be called")

    second = {r.idx: list(r.embedding) for r in embed.embed_entries(rows, embed.model_of("test", dim=16, encode=fails), path).collect()}
    assert first == second
    assert embed.load_cache(spark, path, 8).count() == 0


def test_adaptive_halving():
    calls = []

    def picky(texts):
        calls.append(len(texts))
        if len(texts) > 2 or "bad" in texts:
            raise RuntimeError("too many")
        return [[1.0]] * len(texts)

    assert embed.encode_adaptively(picky, ["a", "b", "bad", "c", "d"], 8) == [[1.0], [1.0], None, [1.0], [1.0]]
    assert embed.model_of("unknown").dim == 768 and embed.model_of("qwen3-embedding:8b").batch == 16


def test_contextualize_skips_and_survives(spark):
    df = corpus(spark, [(0, "a", "text", "s", None, None, "{}", [1.0]), (1, "b", "done", "s", None, None, '{"contextualized": true}', [1.0]), (2, "c", "fails", "s", None, None, "{}", [1.0])])

    def model(prompt):
        if "fails" in prompt:
            raise RuntimeError("no")
        return "Context."

    got = {r.id: r for r in generate.contextualize(df, model, "m", 2).withColumn("m", F.to_json("metadata")).collect()}
    assert got["a"].text == "Context.\n\ntext" and got["a"].embedding is None and '"contextualized":true' in got["a"].m
    assert got["b"].text == "done" and got["b"].embedding is not None
    assert got["c"].text == "fails" and got["c"].embedding is not None


def test_answers_split_retry_and_reduce(spark, three):
    def model(prompt):
        if prompt.count("### [") > 1:
            raise generate.Overflow
        return f"<{prompt.count('### [')}>"

    got = generate.answer_corpus(three, "Q", model)
    assert got["entries"] == 3 and got["batches"] == 1
    assert generate.answer_corpus(three, "Q", model, {"nowhere"})["answer"] == generate.NO_ENTRIES
    waits = []
    tries = iter([generate.RateLimited("retryDelay: 7"), generate.RateLimited("slow"), "ok"])

    def limited(prompt):
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert generate.answer_batch(limited, "Q", "### [s] a\n", wait=waits.append) == ["ok"] and waits == [7.0, 30.0]
    assert generate.retry_delay('{"retryDelay": "12s"}') == 12


def test_single_file_json_is_streamed_in_order(spark, tmp_path):
    rows = [(i, f"d{i}", f"line\n\"{i}\", ]}}" if i % 3 else '{"entries":[', [float(i), 0.5]) for i in range(500)]
    df = spark.createDataFrame(rows, "idx long, id string, text string, embedding array<float>").repartition(7)
    path = str(tmp_path / "x.json")
    assert files.write_json_index(df, path)["total_entries"] == 500
    (part,) = [f for f in os.listdir(path) if f.startswith("part-")]
    with open(os.path.join(path, part)) as f:
        whole = json.load(f)
    assert [e["id"] for e in whole["entries"]] == [f"d{i}" for i in range(500)] and whole["metadata"]["embedding_dim"] == 2
    with open(os.path.join(path, part)) as f:
        assert max(len(x) for x in f) < 1000  # an entry a line, never all in one row
    assert files.read_metadata(spark, path)["total_entries"] == 500
    assert [(r.idx, r.id, r.text, list(r.embedding)) for r in files.read_json_index(spark, path).orderBy("idx").collect()] == rows
    files.write_json_index(df.limit(0), path)
    assert files.read_json_index(spark, path).count() == 0 and files.read_metadata(spark, path)["total_entries"] == 0


def test_json_round_trip_writes_the_whole_corpus(spark, monkeypatch):
    from corpusloom.plans import roster

    written = []
    monkeypatch.setattr(files, "write_json_index", lambda df, path, metadata=None, write=files.write_json_index: written.append(write(df, path, metadata)))
    sf = "/root/testdata/sf0.001"
    shown = roster.QUERIES["json_index_round_trip"](spark, sf).count()
    assert written[0]["total_entries"] == roster.corpus(spark, sf).count() == shown > 60


def test_retry_delay_in_any_case():
    from corpusloom.operators.generate import retry_delay

    assert [retry_delay(m) for m in ("Retry: 30", 'retryDelay": "7s"', "RETRY 4", "no hint")] == [30.0, 7.0, 4.0, 15.0]


def test_word_windows_split_a_text_once(spark):
    from corpusloom.operators.chunking import word_windows

    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(text,), ("a b",), ("",), (None,)], "text string").select(word_windows("text", 100, 20).alias("c"))
    rows = [r.c for r in df.collect()]
    assert len(rows[0]) == 250 and rows[0][1].split()[0] == "w80" and rows[1] == ["a b"]


def test_positions_hold_where_a_second_run_is_cut_differently(spark):
    ours = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        # Without its texts the table is small, so that counting it alone needs fewer partitions.
        text = F.concat(*[F.sha2(F.concat("id", F.lit(f" {k}")), 512) for k in range(8)])
        rows = spark.range(4000).select(F.col("id").cast("string").alias("id")).withColumn("text", text).repartition("id")
        got = files.with_positions(rows).select("id", F.length("text").alias("n"), "idx").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sorted(r.idx for r in got) == list(range(4000)) and len({r.id for r in got}) == 4000


def test_nearest_rows_are_those_of_all_sums(spark):
    from random import Random

    from corpusloom.operators.nearest import nearest

    rng = Random(3)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(6)]) for i in range(300)]  # many ties
    rows += [(300, None), (301, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (302, [9.0] * 6), (303, [float("nan")] * 6), (304, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 50 = 0 OR vec_id = 303").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = nearest(df, asked, 5)
    pairs = df.crossJoin(asked).select("query_id", "vec_id", F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x).alias("sim"))
    pairs.createOrReplaceTempView("nearest_pairs")
    want = spark.sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM nearest_pairs) WHERE n <= 5")
    of = lambda x: sorted((r.query_id, r.n, r.vec_id, str(r.sim)) for r in x.collect())
    assert of(got) == of(want)
    assert "FlatMapCoGroups" in got._jdf.queryExecution().executedPlan().toString()  # products of blocks, not of pairs


def test_lengths_are_taken_where_the_texts_are(spark):
    from corpusloom.operators.packing import assign_batches

    lengths = spark.range(0, 1000, 1, 8).select(F.col("id").alias("idx"), F.lit(10).cast("long").alias("length"))
    got = assign_batches(lengths, 100)
    assert "Coalesce" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.idx, r.batch_id) for r in got.collect()) == [(i, i // 10) for i in range(1000)]


def test_only_prompts_go_to_the_generator(spark):
    df = corpus(spark, [(0, "a", "text", "s", None, None, "{}", [1.0])])
    of = lambda x: x._jdf.queryExecution().executedPlan().toString()
    plan = of(generate.contextualize(df, lambda p: "c", "m", 2))
    assert plan.count("MapInPandas") == of(df).count("MapInPandas") and "ArrowEvalPython" in plan


def test_python_holds_the_vectors_of_one_call(spark):
    rows = spark.range(200).select(F.md5(F.col("id").cast("string")).alias("content_hash"), F.col("id").cast("string").alias("text"))
    made = embed.encode_texts(rows, embed.model_of("test", dim=16, encode=embed.HashingEncoder(16)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and made.where("size(embedding) = 16").count() == 200


def test_sentences_go_through_arrow(spark):
    from corpusloom.operators import chunking

    texts = [" ".join(f"a{k} b{i}." for k in range(40)) for i in range(150)] + ["short", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    got = chunking.with_chunks(df, 20, 4)
    assert {r.idx: r.chunks for r in got.collect()}[149] == chunking.fold_sentences([f"a{k} b149." for k in range(40)], 20, 4)
    assert "pa.Array" in str(chunking._sentence_chunks(20, 4).func.__annotations__)
