"""The pipeline's stages on planted rows, and the entry points with and without this package."""

import random

import pytest

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice(["ren", "tha", "ing", "oun", "hea"]) + rng.choice(["ly", "de", "st", "on"]) + str(rng.randrange(300)) for _ in range(n))
    rows = [(i, line(80), "en", f"s{i % 4}", 0) for i in range(200)]
    toxic = set(range(0, 200, 5))
    rows = [(i, t + " me@example.com", *r) for i, t, *r in rows]
    rows = [(i, t, lang, source, len(t)) for i, t, lang, source, _ in rows]
    rows = [(i, t + " filthword scumlike filthword rottenish" if i in toxic else t, *r) for i, t, *r in rows]
    items = [(k, line(25)) for k in range(5)]
    rows += [(300 + k, line(60) + " " + items[k][1] + " " + line(60), "en", "s1", 0) for k in range(5)]
    rows += [(400, rows[1][1], "en", "s2", 0), (401, rows[1][1] + " more words", "en", "s2", 0), (402, line(40) + " me@example.com", "en", None, 0), (403, None, "en", "s1", None), (404, "", "en", "s1", 0), (405, rows[2][1], "en", "s2", 0), (405, rows[2][1], "en", "s2", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, toxic


def test_stages(spark, corpus):
    path, toxic = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "mixing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert not set(kept["toxicity"]) & toxic and {1, 2, 3, 4, 400, 403, 404} <= set(kept["toxicity"])
    assert not {400, 401, 405} & set(kept["near_duplicates"]) and {1, 2, 403, 404} <= set(kept["near_duplicates"])
    assert not {300, 301, 302, 303, 304} & set(kept["decontamination"])
    assert {1, 2, 403, 404} <= set(kept["decontamination"])
    assert all(kept["personal_data"][i].text.endswith(" [EMAIL]") and kept["personal_data"][i].n_chars == len(kept["personal_data"][i].text) for i in (1, 2, 3))
    assert set(kept["mixing"]) <= set(kept["personal_data"]) and all(r.taken > 0 for r in kept["mixing"].values())


def test_run_is_the_stages_and_empty_tables_pass(spark, corpus, tmp_path):
    path, _ = corpus
    assert pipeline.run(spark, path).count() > 50
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
