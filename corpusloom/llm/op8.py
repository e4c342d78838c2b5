"""Query op8: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .html_text import main_text
from .scoring import map_texts
from .shared import table

NAME = "op8_html_text"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: rows that repeat and rows with null ids or URLs, too; other columns are passed by.

    Null pages have an empty text; an empty table gives an empty result.
    """

    def start():
        def work(pages: list[str | None]) -> list[list]:
            texts = [main_text(h) for h in pages]
            return [texts, [len(t) for t in texts]]

        return work

    return map_texts(pages.select("page_id", "url", "html"), "html", ["page_id", "url"], {"text": "string", "n_chars": "long"}, start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
