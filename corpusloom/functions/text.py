"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it; Java's ``\s`` is narrower.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
SENTENCE_END = rf"(?<=[.!?]){WS}+"

RERANK_TASK = "Given a search query, retrieve relevant passages that answer the query"
CONTEXT_PROMPT = "Write one or two sentences that place the passage below within its source, for use in search.\nSource: %s\nTitle: %s\nDate: %s\n\nPassage:\n%s\n\nAnswer with the sentences alone."


def words(text: Column | str) -> Column:
    """Words between runs of white space; empty for blank texts."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def sentences(text: Column | str) -> Column:
    """Pieces between white space that follows ``.``, ``!`` or ``?``; a last empty piece stays."""
    return F.split(text, SENTENCE_END)


def content_hash(text: Column | str = "text") -> Column:
    """MD5 of the whole text, before any truncation."""
    return F.md5(F.col(text) if isinstance(text, str) else text)


def clipped(text: Column | str, most: int) -> Column:
    return F.substring(text, 1, most)


def _or(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def context_prompt() -> Column:
    """The prompt that asks for a passage's context."""
    return F.format_string(CONTEXT_PROMPT, _or("source", "unknown"), _or("title", "untitled"), _or("date", "unknown"), clipped("text", 2000))


def packed_entry() -> Column:
    """How an entry reads within a batch: heading with source, title or id and date, then the text and a blank line."""
    date = F.when(F.coalesce(F.col("date"), F.lit("")) != "", F.concat(F.lit(" ("), F.col("date"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("### ["), _or("source", "unknown"), F.lit("] "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("id")), date, F.lit("\n"), F.col("text"), F.lit("\n\n"))


def rerank_document() -> Column:
    return F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "), clipped("text", 500))


def rerank_query(query: str) -> str:
    return f"Instruct: {RERANK_TASK}\nQuery: {query}"
