"""Query op7: a verdict for the URL of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter
from .scoring import score_texts
from .shared import table

NAME = "op7_url_filter"
RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
#: The trees learn from at most so many labelled URLs.
TRAIN_ROWS = 8000


def fitted(pages: DataFrame, labelled: DataFrame | None = None, rules: list[url_filter.Rule] = RULES, rows: int = TRAIN_ROWS) -> url_filter.Trees:
    """The trees, from a table (url, label) or else from the URLs of ``pages`` that the rules judge, without the held-out fold.

    Where no URL is labelled, or all alike, every score is the (smoothed) share of label 1.
    """
    sample = labelled if labelled is not None else url_filter.ruled_sample(pages, "url", rules, rows)
    found = sample.where("url IS NOT NULL AND label IS NOT NULL").where(~url_filter.held_out_url(F.col("url"))).orderBy(F.xxhash64("url"), "url", "label").limit(rows).collect()
    return url_filter.train([r.url for r in found], [int(r.label) for r in found])


def judge(pages: DataFrame, model: url_filter.Trees, rules: list[url_filter.Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. Null URLs and those without ``://`` have no host or path and are
    judged by the trees; rows that repeat are judged alike; other columns are passed by; an empty table gives an empty result."""
    scored = score_texts(pages.select("page_id", "url"), model, text="url", keep=["page_id", "url"])
    judged = scored.withColumn("host", url_filter.host_of(F.col("url"))).withColumn("path", url_filter.path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", url_filter.rule_of(host, path, rules).alias("rule"), F.coalesce(url_filter.rule_of(host, path, rules, "verdict"), own).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, fitted(pages))
