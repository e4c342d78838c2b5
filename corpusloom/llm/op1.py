"""Query op1: all documents mixed by source, with its SQL.

Chances are unequal within a source: in proportion to 1 for documents of fewer than 64 words, 2 of fewer than 512, else 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix_sources
from .shared import table

NAME = "op1_pareto_mix"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most_copies=3, seed=17)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), e AS (
  SELECT *, CASE WHEN size >= 512 THEN 3 WHEN size >= 64 THEN 2 ELSE 1 END AS importance FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, (CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here,
    row_number() OVER (ORDER BY cap / weight, k) AS turn FROM w
), n AS (
  SELECT arg_min(here, turn) AS level FROM l WHERE cap > here * weight
), t AS (
  SELECT source, k, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM n) * weight, cap::DOUBLE)) AS target FROM l
), i AS (
  SELECT t.k, t.target, importance, sum(size)::BIGINT AS words FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), b AS (
  SELECT *, (target - 3 * coalesce(sum(words) OVER (PARTITION BY k ORDER BY importance DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / nullif(sum(words * importance) OVER (PARTITION BY k ORDER BY importance DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS here FROM i
), v AS (
  SELECT k, arg_max(here, importance) AS level FROM b WHERE here * importance < 3 GROUP BY k
), r AS (
  SELECT d.doc_id, d.size, t.k, t.source_size, t.target,
    CASE WHEN d.size > 0 THEN coalesce(least(v.level * d.importance, 3.0::DOUBLE), 3.0::DOUBLE) ELSE 0 END AS expected,
    (('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM e d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN v ON v.k = t.k
), q AS (
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM r
), o AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM q
), c AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY k) AS left_over,
    sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY k ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS run FROM o
), m AS (
  SELECT *, CASE WHEN rank IS NOT NULL AND run <= left_over THEN 1 ELSE 0 END AS more FROM c
), g AS (
  SELECT *, target - sum((whole + more) * size) OVER (PARTITION BY k) AS gap FROM m
), f AS (
  SELECT *, CASE WHEN more = 0 AND size > 0 AND rank IS NOT NULL AND whole < 3 AND abs(size - gap) < abs(gap) THEN 1 END AS may FROM g
), z AS (
  SELECT *, CASE WHEN may = 1 THEN row_number() OVER (PARTITION BY k, may ORDER BY abs(size - gap), rank, doc_id, size) END AS n FROM f
)
SELECT doc_id, size, source_size, target, ((whole + more + CASE WHEN n = 1 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM z
"""
