"""The engine's queries over the test tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..functions.dates import age_days, freshness, with_parsed_dates
from ..operators import bm25, chunking, embed, generate, merge, neighbors, packing
from ..operators.nearest import nearest
from ..schema import as_entries, as_json, is_valid
from ..scratch import scratch
from ..sources import files
from .request import SearchRequest, dense_ranks, expand_sources, search

AS_OF = datetime(2025, 1, 1)
HALF_LIVES = {"src0": 30.0, "src1": None}
QUERY_VECTOR = 7
GROUPS = {"first": ["src0", "src1"], "second": ["src2", "src3"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ENTRIES_SQL = """e AS (
  SELECT d.doc_id AS idx, d.doc_id::VARCHAR AS id, d.text, d.source, substring(d.text, 1, 40) AS title,
    strftime(DATE '2024-01-01' + (d.doc_id % 365)::INTEGER, '%Y-%m-%d') AS date, d.lang, d.n_chars FROM documents d
), v AS (
  SELECT e.*, m.embedding::DOUBLE[] AS embedding FROM e JOIN embeddings m ON m.vec_id = e.idx
), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
s AS (SELECT v.*, list_dot_product(v.embedding, q.q) AS sim, (DATE '2025-01-01' - CAST(v.date AS DATE))::DOUBLE AS age FROM v, q),
f AS (SELECT s.*, CASE WHEN source = 'src1' THEN 1.0 WHEN age <= 0 THEN 1.0 WHEN source = 'src0' THEN pow(0.5, age / 30) ELSE pow(0.5, age / 365) END AS fresh FROM s)"""


def entries(spark: SparkSession, sf_dir: str, with_metadata: bool = True) -> DataFrame:
    """Documents as entries: title and date are derived, metadata holds lang, n_chars and the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")), "yyyy-MM-dd")
    rows = docs.select("doc_id", F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("id"), "text", "source", F.substring("text", 1, 40).alias("title"), date.alias("date"), "lang", "n_chars")
    if with_metadata:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
        rows = rows.join(labels, "doc_id", "left").withColumn("metadata", F.to_variant_object(F.struct("lang", "n_chars", "quality", "toxic"))).drop("quality", "toxic")
    return rows.drop("doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that have a vector, with parsed dates."""
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")
    rows = entries(spark, sf_dir).join(vecs, "idx")
    return rows.withColumn("date_parsed", F.col("date").cast("timestamp_ntz"))


def query_vector(spark: SparkSession, sf_dir: str) -> tuple[float, ...]:
    return tuple(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == QUERY_VECTOR).first()["embedding"])


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _search(spark, sf_dir, index=None, text="", rows=None, **settings) -> DataFrame:
    request = SearchRequest(text, query_vector(spark, sf_dir), as_of=AS_OF, **settings)
    return search(corpus(spark, sf_dir) if rows is None else rows, request, index)


def _short(df: DataFrame) -> DataFrame:
    return df.select("pos", "id", "source", F.round("similarity", 6).alias("similarity"))


def _short_sql(where: str = "", order: str = "sim DESC, idx", top: int = 20, source: str = "f") -> str:
    return f"WITH {ENTRIES_SQL} SELECT (row_number() OVER (ORDER BY {order}) - 1)::INTEGER AS pos, id, source, round(sim, 6) AS similarity FROM {source} {where} ORDER BY {order} LIMIT {top}"


@query(f"WITH {ENTRIES_SQL} SELECT (row_number() OVER (ORDER BY sim DESC, idx) - 1)::INTEGER AS pos, id, source, title, date, substring(text, 1, 300) AS text, round(sim, 6) AS similarity FROM f ORDER BY sim DESC, idx LIMIT 20")
def dense_topk(spark, sf_dir):
    return _search(spark, sf_dir).select("pos", "id", "source", "title", "date", "text", F.round("similarity", 6).alias("similarity"))


@query(_short_sql("WHERE source IN ('src0', 'src3', 'src4') AND lang = 'en'", top=15))
def dense_filtered(spark, sf_dir):
    return _short(_search(spark, sf_dir, top_k=15, sources=frozenset({"src0", "src3", "src4"}), entry_filter=F.variant_get("metadata", "$.lang", "string") == "en"))


@query(_short_sql("WHERE sim >= 0.05", top=1000))
def min_similarity(spark, sf_dir):
    return _short(_search(spark, sf_dir, top_k=1000, min_similarity=0.05))


@query(_short_sql("WHERE CAST(date AS DATE) >= DATE '2024-06-01'"))
def since_filter(spark, sf_dir):
    return _short(_search(spark, sf_dir, since=datetime(2024, 6, 1)))


@query(_short_sql(order="date DESC, sim DESC, idx"))
def sort_by_date(spark, sf_dir):
    return _short(_search(spark, sf_dir, sort_by="date"))


@query(_short_sql(order="sim * (1 - 0.3 + 0.3 * fresh) DESC, idx"))
def freshness_rank(spark, sf_dir):
    return _short(_search(spark, sf_dir, freshness_weight=0.3, half_lives=HALF_LIVES))


@query(f"WITH {ENTRIES_SQL} SELECT id, source, age::BIGINT AS age, round(fresh, 6) AS fresh FROM f")
def half_life_map(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", "source", age_days("date_parsed", AS_OF).alias("age"), F.round(freshness(AS_OF, HALF_LIVES), 6).alias("fresh"))


@query(f"""WITH {ENTRIES_SQL}, k AS (SELECT *, CASE WHEN idx % 7 <> 0 THEN (idx % 50)::VARCHAR END AS k FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY k, CASE WHEN k IS NULL THEN idx END ORDER BY sim DESC, idx) AS rn FROM k)
SELECT (row_number() OVER (ORDER BY sim DESC, idx) - 1)::INTEGER AS pos, id, source, round(sim, 6) AS similarity FROM r WHERE rn = 1 ORDER BY sim DESC, idx LIMIT 40""")
def dedup_parent(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("metadata", F.to_variant_object(F.struct(F.when(F.col("idx") % 7 != 0, (F.col("idx") % 50).cast("string")).alias("parent_id"))))
    return _short(_search(spark, sf_dir, rows=rows, top_k=40))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0)
SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) - 1)::INTEGER AS rank, round(sim, 6) AS sim FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5""")
def batch_topk(spark, sf_dir):
    """A stated set of queries (every row whose id is divisible by 50) against all rows, in blocks of bounded size that meet
    pairwise; every query keeps its best rows only."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return nearest(rows, asked, 5).select("query_id", "vec_id", (F.col("n") - 1).alias("rank"), F.round("sim", 6).alias("sim"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 3) + 0.0 AS unit_sum, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 3, 5) AS norm FROM embeddings")
def normalize_vectors(spark, sf_dir):
    longer = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x * 3).alias("v"))
    return longer.select("vec_id", (F.round(F.aggregate(vectors.unit("v"), F.lit(0.0), lambda s, x: s + x.cast("double")), 3) + 0.0).alias("unit_sum"), F.round(vectors.norm("v"), 5).alias("norm"))


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS entries FROM documents GROUP BY 1")
def source_counts(spark, sf_dir):
    return files.source_counts(entries(spark, sf_dir, False))


@query("SELECT count(*) AS entries, sum(length(text))::BIGINT AS chars, (sum(length(text)) // 4)::BIGINT AS tokens FROM documents")
def corpus_stats(spark, sf_dir):
    return packing.corpus_stats(entries(spark, sf_dir, False))


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY idx) AS r FROM e)
SELECT source, count(*) AS entries, string_agg(coalesce(nullif(title, ''), id), ', ' ORDER BY idx) FILTER (WHERE r <= 5) || CASE WHEN count(*) > 5 THEN ', ...' ELSE '' END AS titles FROM r GROUP BY source""")
def manifest(spark, sf_dir):
    return packing.manifest(entries(spark, sf_dir, False))


def _halves(spark, sf_dir) -> list[DataFrame]:
    rows = entries(spark, sf_dir, False).select("idx", "id", "text", "source")
    return [rows.where("idx % 3 <> 0"), rows.where("idx % 2 = 0").withColumn("text", F.concat(F.lit("changed "), "text"))]


@query("SELECT id, md5(text) AS hash, input_no FROM (SELECT doc_id::VARCHAR AS id, text, 0 AS input_no FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id::VARCHAR, 'changed ' || text, 1 FROM documents WHERE doc_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY input_no) = 1")
def merge_first_wins(spark, sf_dir):
    return merge.merge(_halves(spark, sf_dir)).select("id", F.md5("text").alias("hash"), "input_no")


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS entries FROM (SELECT source FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT source FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def merge_source_counts(spark, sf_dir):
    return merge.merged_source_counts(_halves(spark, sf_dir))


@query("SELECT doc_id AS idx, doc_id::VARCHAR AS id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id + 1 + (SELECT max(doc_id) FROM documents WHERE doc_id % 3 <> 0), doc_id::VARCHAR FROM documents WHERE doc_id % 2 = 0")
def add_index(spark, sf_dir):
    return merge.add_index(*_halves(spark, sf_dir)).select("idx", "id")


@query("SELECT md5(text) AS content_hash, min(doc_id) AS idx, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    return entries(spark, sf_dir, False).groupBy(tx.content_hash().alias("content_hash")).agg(F.min("idx").alias("idx"), F.count("*").alias("copies"))


def _seeded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = entries(spark, sf_dir, False).withColumn("content_hash", tx.content_hash())
    return rows, rows.where("idx % 2 = 0").select("content_hash").distinct()


@query("SELECT doc_id AS idx FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def cache_hits(spark, sf_dir):
    return embed.cache_hits(*_seeded(spark, sf_dir)).select("idx")


@query("SELECT DISTINCT md5(text) AS content_hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def cache_misses(spark, sf_dir):
    return embed.cache_misses(*_seeded(spark, sf_dir)).select("content_hash")


@query("SELECT count(*) FILTER (WHERE length(text) > 2000) AS truncated FROM documents")
def truncated_texts(spark, sf_dir):
    return embed.truncated_count(entries(spark, sf_dir, False), 2000)


@query("SELECT count(*) FILTER (WHERE doc_id % 5 <> 0 AND text <> '') AS valid, count(*) AS rows FROM documents")
def validate_entries(spark, sf_dir):
    rows = entries(spark, sf_dir, False).withColumn("id", F.when(F.col("idx") % 5 != 0, F.col("id")))
    return rows.agg(F.count_if(is_valid()).alias("valid"), F.count("*").alias("rows"))


@query(f"""WITH {ENTRIES_SQL} SELECT id, md5('### [' || coalesce(nullif(source, ''), 'unknown') || '] ' || coalesce(nullif(title, ''), id) || ' (' || date || ')' || chr(10) || text || chr(10) || chr(10)) AS packed,
coalesce(title, '') || ' ' || substring(text, 1, 500) AS document FROM e""")
def formatted_entries(spark, sf_dir):
    return entries(spark, sf_dir, False).select("id", F.md5(tx.packed_entry()).alias("packed"), tx.rerank_document().alias("document"))


PROMPT_SQL = "'" + tx.CONTEXT_PROMPT.replace("%s", "' || {} || '").replace("\n", "' || chr(10) || '") + "'"


@query(f"WITH {ENTRIES_SQL} SELECT id, " + PROMPT_SQL.format("coalesce(nullif(source, ''), 'unknown')", "coalesce(nullif(title, ''), 'untitled')", "coalesce(nullif(date, ''), 'unknown')", "substring(text, 1, 2000)") + " AS prompt FROM e")
def context_prompts(spark, sf_dir):
    return entries(spark, sf_dir, False).select("id", tx.context_prompt().alias("prompt"))


@query("SELECT doc_id::VARCHAR AS id, source FROM documents WHERE source IN ('src0', 'src1', 'src9')")
def source_groups(spark, sf_dir):
    return entries(spark, sf_dir, False).where(F.col("source").isin(sorted(expand_sources(["first", "src9"], GROUPS)))).select("id", "source")


WORDS_SQL = r"w AS (SELECT doc_id AS idx, doc_id::VARCHAR AS id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)"


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"greatest(((len(w) - {size}) + {step} - 1) // {step} + 1, 1)"


@query(f"WITH {WORDS_SQL} SELECT idx, i::INTEGER AS chunk_index, array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS chunk FROM (SELECT *, unnest(range({_windows_sql(100, 20)})) AS i FROM w)")
def chunk_words(spark, sf_dir):
    rows = entries(spark, sf_dir, False)
    return rows.select("idx", F.posexplode(chunking.word_windows("text", 100, 20)).alias("chunk_index", "chunk"))


SENTENCES_SQL = rf"""WITH RECURSIVE {WORDS_SQL}, s AS (
  SELECT idx, id, text, len(w) AS n, string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)) AS s FROM w WHERE len(w) > 200
), p AS (SELECT idx, id, text, s, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''))) AS c FROM s WHERE len(s) > 1
), t AS (
  SELECT idx, s, c, 1 AS i, []::VARCHAR[] AS chunks, []::VARCHAR[] AS held, []::BIGINT[] AS counts FROM p
  UNION ALL
  SELECT idx, s, c, i + 1,
    CASE WHEN flush THEN list_append(chunks, array_to_string(held, ' ')) ELSE chunks END,
    list_append(CASE WHEN flush THEN CASE WHEN keep = 0 THEN []::VARCHAR[] ELSE held[len(held) - keep + 1 :] END ELSE held END, s[i]),
    list_append(CASE WHEN flush THEN CASE WHEN keep = 0 THEN []::BIGINT[] ELSE counts[len(counts) - keep + 1 :] END ELSE counts END, c[i])
  FROM (SELECT *, len(held) > 0 AND coalesce(list_sum(counts), 0) + c[i] > 200 AS flush,
      len(list_filter(range(1, len(counts) + 1), lambda k: list_sum(counts[len(counts) - k + 1 :]) <= 30)) AS keep FROM t WHERE i <= len(s))
), d AS (SELECT idx, CASE WHEN len(chunks) > 0 AND list_sum(counts) < 50 THEN list_append(chunks[: len(chunks) - 1], chunks[len(chunks)] || ' ' || array_to_string(held, ' ')) ELSE list_append(chunks, array_to_string(held, ' ')) END AS chunks FROM t WHERE i > len(s))
SELECT d.idx, (i - 1)::INTEGER AS chunk_index, chunks[i] AS chunk FROM d, unnest(range(1, len(chunks) + 1)) AS u(i)"""


@query(SENTENCES_SQL)
def chunk_sentences(spark, sf_dir):
    long = entries(spark, sf_dir, False).where((tx.word_count("text") > 200) & (F.size(tx.sentences("text")) > 1))
    return chunking.with_chunks(long, 200, 30).select("idx", F.posexplode("chunks").alias("chunk_index", "chunk"))


@query()
def chunk_entries(spark, sf_dir):
    rows = chunking.chunk_entries(entries(spark, sf_dir), 200, 30)
    return rows.select("id", "title", F.md5("text").alias("hash"), "parent_id", "chunk_index", "total_chunks", F.variant_get("metadata", "$.parent_id", "string").alias("meta_parent"), F.variant_get("metadata", "$.lang", "string").alias("lang"))


@query(rf"""WITH {WORDS_SQL}, g AS (SELECT *, regexp_replace(text, '[.!?]', ',', 'g') AS t FROM w), k AS (SELECT unnest([200, 500]) AS scale),
l AS (SELECT g.idx, g.id, g.t, list_filter(regexp_split_to_array(g.t, '\s+'), lambda x: x <> '') AS w, scale FROM g, k WHERE len(w) > 200),
n AS (SELECT *, CASE WHEN len(w) <= scale THEN 1 ELSE ((len(w) - scale) + scale - 51) // (scale - 50) + 1 END AS n FROM l)
SELECT id, NULL::INTEGER AS scale, md5(t) AS hash, NULL::INTEGER AS chunk_index FROM g WHERE len(w) <= 200
UNION ALL SELECT id || '__s' || scale, scale, md5(t), NULL FROM n WHERE n = 1
UNION ALL SELECT id || '__s' || scale || '_chunk_' || i, scale, md5(array_to_string(w[i * (scale - 50) + 1 : i * (scale - 50) + scale], ' ')), i::INTEGER FROM (SELECT *, unnest(range(n)) AS i FROM n WHERE n > 1)""")
def multiscale_words(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[.!?]", ","))
    return chunking.multiscale_chunk_entries(rows, [200, 500], 50).select("id", "scale", F.md5("text").alias("hash"), "chunk_index")


def _bm25_sql(match: str, phrases: dict[str, tuple[str, ...]], limit: int = 200, select: str | None = None) -> str:
    """SQL for BM25 in the plain analyzer; phrases maps p0, p1, ... to terms."""
    cols = {"t": "title", "x": "text", "s": "source"}
    lists = ", ".join(f"regexp_extract_all(lower({c}), '[a-z0-9]+') AS {k}" for k, c in cols.items())
    counts = ", ".join(f"{' + '.join(f'({w} * {n})' for w, n in ((10, _count_sql('t', p)), (1, _count_sql('x', p)), (0, _count_sql('s', p))))} AS tf{k}, ({' + '.join(_count_sql(c, p) for c in 'txs')}) > 0 AS m{k}" for k, p in phrases.items())
    df = ", ".join(f"count(*) FILTER (WHERE m{k}) AS df{k}" for k in phrases)
    score = lambda k: f"(CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{k} + 0.5) / (df{k} + 0.5)) END * (tf{k} * 2.2) / (tf{k} + 1.2 * (0.25 + 0.75 * len / avgdl)))"
    return f"""WITH {ENTRIES_SQL}, k AS (SELECT idx, id, {lists} FROM e), c AS (SELECT idx, id, len(t) + len(x) + len(s) AS len, {counts} FROM k),
g AS (SELECT count(*) AS n, sum(len)::DOUBLE / count(*) AS avgdl, {df} FROM c),
b AS (SELECT c.idx, c.id, {match.format(**{k: score(k) for k in phrases})} AS bm25 FROM c, g) """ + (select or f"SELECT id, round(bm25, 6) AS bm25 FROM b WHERE bm25 IS NOT NULL ORDER BY bm25 DESC, idx LIMIT {limit}")


def _count_sql(column: str, terms: tuple[str, ...]) -> str:
    hit = " AND ".join(f"{column}[i + {k}] = '{t}'" for k, t in enumerate(terms))
    return f"len(list_filter(range(1, len({column}) + 1), lambda i: {hit}))"


def _plain(spark, sf_dir) -> bm25.TextIndex:
    return bm25.build(entries(spark, sf_dir, False), "plain")


def _hits(spark, sf_dir, text) -> DataFrame:
    return bm25.search(_plain(spark, sf_dir), text).select(F.col("idx").cast("string").alias("id"), F.round("bm25", 6).alias("bm25"))


@query(_bm25_sql("CASE WHEN mp0 AND mp1 THEN {p0} + {p1} END", {"p0": ("stupid",), "p1": ("clown",)}))
def bm25_plain(spark, sf_dir):
    return _hits(spark, sf_dir, "stupid clown")


@query(_bm25_sql("CASE WHEN mp0 OR (mp1 AND NOT mp2) THEN CASE WHEN mp0 THEN {p0} ELSE 0 END + CASE WHEN mp1 AND NOT mp2 THEN {p1} ELSE 0 END END", {"p0": ("idiot",), "p1": ("of", "the"), "p2": ("src0",)}))
def bm25_boolean(spark, sf_dir):
    return _hits(spark, sf_dir, "idiot OR of-the NOT src0")


@query(_bm25_sql("CASE WHEN mp0 THEN {p0} END", {"p0": ("src3",)}))
def bm25_fields(spark, sf_dir):
    """A hit in the source alone counts, with score 0."""
    return _hits(spark, sf_dir, "src3")


HYBRID_SQL = _bm25_sql("CASE WHEN mp0 OR mp1 THEN CASE WHEN mp0 THEN {p0} ELSE 0 END + CASE WHEN mp1 THEN {p1} ELSE 0 END END", {"p0": ("scum",), "p1": ("loser",)}, select="""
, h AS (SELECT idx, bm25 FROM b WHERE bm25 IS NOT NULL ORDER BY bm25 DESC, idx LIMIT 200),
hr AS (SELECT idx, row_number() OVER (ORDER BY bm25 DESC, idx) - 1 AS bm25_rank FROM h WHERE idx IN (SELECT idx FROM f)),
r AS (SELECT f.*, row_number() OVER (ORDER BY sim DESC, f.idx) - 1 AS dense_rank, bm25_rank FROM f LEFT JOIN hr ON hr.idx = f.idx),
z AS (SELECT *, 1 / (60 + dense_rank) + coalesce(1 / (60 + bm25_rank), 0) AS rrf, (1 / (60 + dense_rank) + coalesce(1 / (60 + bm25_rank), 0)) * (0.8 + 0.2 * fresh) AS score FROM r)
SELECT (row_number() OVER (ORDER BY score DESC, idx) - 1)::INTEGER AS pos, id, round(sim, 4) AS dense_sim, dense_rank, bm25_rank, round(rrf, 6) AS rrf_total, round(fresh, 4) AS freshness_factor FROM z ORDER BY score DESC, idx LIMIT 30""")


@query(HYBRID_SQL)
def hybrid_provenance(spark, sf_dir):
    got = _search(spark, sf_dir, _plain(spark, sf_dir), "scum OR loser", top_k=30, hybrid=True, provenance=True, freshness_weight=0.2, half_lives=HALF_LIVES)
    return got.select("pos", "id", "provenance.dense_sim", "provenance.dense_rank", "provenance.bm25_rank", "provenance.rrf_total", "provenance.freshness_factor")


@query(HYBRID_SQL.replace("* (0.8 + 0.2 * fresh)", "").split("SELECT (row_number() OVER (ORDER BY score DESC")[0] + "SELECT (row_number() OVER (ORDER BY score DESC, idx) - 1)::INTEGER AS pos, id, source, round(sim, 6) AS similarity FROM z ORDER BY score DESC, idx LIMIT 20")
def hybrid_rrf(spark, sf_dir):
    return _short(_search(spark, sf_dir, _plain(spark, sf_dir), "scum OR loser", hybrid=True))


@query(f"WITH {ENTRIES_SQL} SELECT idx, row_number() OVER (ORDER BY sim DESC, idx) - 1 AS dense_rank FROM f")
def dense_rank_all(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("sim", vectors.dot("embedding", vectors.literal(query_vector(spark, sf_dir))))
    return dense_ranks(rows)


def _turns(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.array(F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))).alias("keys"), F.length("text").alias("n"))


TURNS_SQL = """t AS (SELECT conv_id * 1000 + turn AS idx, conv_id, length(text) AS n FROM conversations),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, idx) - 1 AS pos FROM t), a AS (SELECT * FROM r WHERE pos < 10),
m AS (SELECT r.idx, min(a.pos) AS first_anchor FROM a JOIN r ON r.conv_id = a.conv_id WHERE r.idx NOT IN (SELECT idx FROM a) GROUP BY r.idx),
p AS (SELECT first_anchor, coalesce(sum(count(*)) OVER (ORDER BY first_anchor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m GROUP BY first_anchor),
x AS (SELECT m.* FROM m JOIN p USING (first_anchor) WHERE before < 12)"""


@query(f"WITH {TURNS_SQL} SELECT idx, first_anchor::INTEGER AS first_anchor FROM x")
def neighbors_expand(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    anchors = turns.orderBy(F.desc("n"), "idx").limit(10)
    anchors = anchors.select("idx", (F.row_number().over(Window.orderBy(F.desc("n"), "idx")) - 1).alias("pos"))
    return neighbors.expand(neighbors.edges(turns, F.col("keys")), anchors, max_neighbors=12)


@query(f"""WITH {TURNS_SQL}, y AS (SELECT r.idx, r.pos, CASE WHEN x.idx IS NOT NULL THEN r.n * 0.7 + (SELECT avg(n) FROM a) * 0.3 ELSE r.n END AS score, x.idx IS NOT NULL AS expanded FROM r LEFT JOIN x USING (idx))
SELECT idx, round(score, 6) AS score, expanded, (row_number() OVER (ORDER BY score DESC, pos) - 1)::INTEGER AS pos FROM y""")
def spread_scores(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    results = turns.select("idx", F.col("n").cast("double").alias("score"), (F.row_number().over(Window.orderBy(F.desc("n"), "idx")) - 1).alias("pos"))
    got = neighbors.spread_scores(results, neighbors.edges(turns, F.col("keys")), boost=0.3, max_neighbors=12)
    return got.select("idx", F.round("score", 6).alias("score"), F.col("_expanded").alias("expanded"), "pos")


PACK_SQL = f"""WITH RECURSIVE {ENTRIES_SQL}, b AS (SELECT idx, '### [' || source || '] ' || coalesce(nullif(title, ''), id) || ' (' || date || ')' || chr(10) || text || chr(10) || chr(10) AS body FROM e),
o AS (SELECT idx, body, length(body) AS n, row_number() OVER (ORDER BY idx) AS i FROM b),
t AS (SELECT 0::BIGINT AS i, 0::BIGINT AS batch, 0::BIGINT AS used, false AS holds, false AS was_big
  UNION ALL SELECT o.i, CASE WHEN holds AND (o.n > 20000 OR used + o.n > 20000) THEN batch + 1 WHEN was_big THEN batch + 1 ELSE batch END,
    CASE WHEN o.n > 20000 THEN 0 WHEN holds AND used + o.n > 20000 THEN o.n ELSE CASE WHEN holds THEN used ELSE 0 END + o.n END, o.n <= 20000, o.n > 20000
  FROM t JOIN o ON o.i = t.i + 1)
SELECT batch AS batch_id, count(*) AS entries, md5(string_agg(substring(body, 1, 20000), '' ORDER BY o.i)) AS hash, (sum(least(n, 20000)) // 3)::BIGINT AS est_tokens FROM t JOIN o ON o.i = t.i GROUP BY batch"""


@query(PACK_SQL)
def pack_batches(spark, sf_dir):
    return packing.pack_batches(entries(spark, sf_dir, False), 20_000).select("batch_id", "entries", F.md5("text").alias("hash"), "est_tokens")


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS hash, source, lang FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = scratch(spark, "jsonl")
    as_json(as_entries(entries(spark, sf_dir))).write.text(path)
    return files.read_jsonl(spark, path).select("id", F.md5("text").alias("hash"), "source", F.variant_get("metadata", "$.lang", "string").alias("lang"))


@query("SELECT doc_id::VARCHAR AS id, source, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM documents JOIN embeddings ON vec_id = doc_id WHERE source IN ('src2', 'src5')")
def index_round_trip(spark, sf_dir):
    path = scratch(spark, "index")
    files.write_index(corpus(spark, sf_dir), path, {"embedding_model": "test"})
    rows = files.read_index(spark, path, {"src2", "src5"})
    return rows.select("id", "source", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id::VARCHAR AS id, md5(text) AS hash, 64 AS dim FROM documents JOIN embeddings ON vec_id = doc_id")
def json_index_round_trip(spark, sf_dir):
    """The whole corpus goes through the file and comes back."""
    path, split = scratch(spark, "json"), scratch(spark, "split")
    files.write_json_index(corpus(spark, sf_dir), path + ".json")
    files.json_to_split(spark, path + ".json", split)
    return files.read_index(spark, split).select("idx", "id", F.md5("text").alias("hash"), F.size("embedding").alias("dim"))


@query(f"WITH {ENTRIES_SQL} SELECT id, CAST(date AS TIMESTAMP) AS parsed FROM e")
def parse_dates(spark, sf_dir):
    return with_parsed_dates(entries(spark, sf_dir, False), AS_OF).select("id", F.col("date_parsed").alias("parsed"))


@query()
def embed_entries(spark, sf_dir):
    model = embed.model_of("hashing", dim=64, encode=embed.HashingEncoder(64))
    got = embed.embed_entries(entries(spark, sf_dir, False), model, scratch(spark, "cache"))
    return got.select("idx", "content_hash", F.round(vectors.norm("embedding"), 4).alias("norm"))


def _context(prompt: str) -> str:
    return f"A passage of {len(prompt)} characters."


@query(f"WITH {ENTRIES_SQL} SELECT id, md5('A passage of ' || length(" + PROMPT_SQL.format("coalesce(nullif(source, ''), 'unknown')", "coalesce(nullif(title, ''), 'untitled')", "coalesce(nullif(date, ''), 'unknown')", "substring(text, 1, 2000)") + ") || ' characters.' || chr(10) || chr(10) || text) AS hash, 'true' AS flag FROM e")
def contextualize(spark, sf_dir):
    got = generate.contextualize(entries(spark, sf_dir), _context, "test", 2)
    return got.select("id", F.md5("text").alias("hash"), F.variant_get("metadata", "$.contextualized", "string").alias("flag"))


def _lengths(query_text: str, documents: list[str]) -> list[float]:
    return [float(len(d)) for d in documents]


@query(f"""WITH {ENTRIES_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY sim DESC, idx) - 1 AS pre FROM f ORDER BY sim DESC, idx LIMIT 30),
r AS (SELECT *, length(coalesce(title, '') || ' ' || substring(text, 1, 500))::DOUBLE AS rerank_score FROM p)
SELECT (row_number() OVER (ORDER BY rerank_score DESC, pre) - 1)::INTEGER AS pos, id, rerank_score, pre::INTEGER AS pre_rank FROM r ORDER BY rerank_score DESC, pre LIMIT 10""")
def rerank(spark, sf_dir):
    got = _search(spark, sf_dir, top_k=10, reranker=generate.rerank(_lengths), provenance=True)
    return got.select("pos", "id", "rerank_score", F.col("provenance.pre_rank").alias("pre_rank"))


def _count_entries(prompt: str) -> str:
    return str(prompt.count("### ["))


@query("SELECT 'src4' AS source, count(*) AS entries FROM documents WHERE source = 'src4'")
def answer_corpus(spark, sf_dir):
    got = generate.answer_corpus(entries(spark, sf_dir, False), "How many?", _count_entries, {"src4"}, 200_000)
    return spark.createDataFrame([("src4", got["entries"])], "source string, entries long")
