"""Operators that ask a text generator: context for entries, answers over a whole corpus, and reranking."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import context_prompt, rerank_document, rerank_query
from .chunking import merge_metadata
from .packing import CHARS_PER_TOKEN, MAX_CHARS, manifest_text, pack_batches

Generate = Callable[[str], str]
NO_ENTRIES = "No entries match."
RETRY_AFTER = re.compile(r"""retry(?:delay)?[\s:"]*(?P<seconds>[0-9]+)""", re.IGNORECASE)


class Overflow(Exception):
    """The prompt was longer than the generator takes."""


class RateLimited(Exception):
    """Too many calls; the message may say how long to wait."""


def retry_delay(message: str, default: float = 15.0) -> float:
    """Seconds named behind ``retry`` or ``retryDelay``, in any case, in a provider's message."""
    named = RETRY_AFTER.search(message)
    return float(named["seconds"]) if named else default


def is_contextualized():
    return F.coalesce(F.variant_get("metadata", "$.contextualized", "string").isin("true", "1"), F.lit(False))


def contextualize(entries: DataFrame, generate: Generate, model: str = "", concurrency: int = 10) -> DataFrame:
    """Texts with their context before them, flagged in the metadata; entries that have it are left as they are, and
    so are those whose call fails. A new text has neither hash nor vector."""
    def ask(prompt: str) -> str | None:
        try:
            return generate(prompt) or None
        except Exception as error:  # noqa: BLE001 - an entry without context is still an entry
            print(f"no context: {error}")
            return None

    # Only prompts go to Python, and contexts come back; texts and metadata stay where they are.
    @F.pandas_udf("string")
    def context(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(concurrency) as pool:
            for prompts in batches:
                yield pd.Series(list(pool.map(lambda p: None if p is None else ask(p), prompts)), dtype=object)

    asked = F.when(~is_contextualized(), context_prompt())
    got = entries.withColumn("__context", context.asNondeterministic()(asked))
    new = F.col("__context").isNotNull()
    got = got.withColumn("text", F.when(new, F.concat("__context", F.lit("\n\n"), "text")).otherwise(F.col("text")))
    got = got.withColumn("metadata", F.when(new, merge_metadata("metadata", {"contextualized": F.lit(True), "context_model": F.lit(model)})).otherwise(F.col("metadata")))
    for c in ("content_hash", "embedding"):
        if c in got.columns:
            got = got.withColumn(c, F.when(~new, F.col(c)))
    return got.select(entries.columns)


def rerank(score: Callable[[str, list[str]], list[float]]) -> Callable[[str, DataFrame], DataFrame]:
    """A reranker for requests: rows (a pool of bounded size) with ``rerank_score`` from ``score(query, documents)``."""

    def apply(query: str, rows: DataFrame) -> DataFrame:
        pool = rows.select("idx", rerank_document().alias("document")).coalesce(1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"idx": batch["idx"], "rerank_score": [float(s) for s in score(rerank_query(query), batch["document"].tolist())]})

        return rows.join(F.broadcast(pool.mapInPandas(run, StructType([pool.schema["idx"], StructField("rerank_score", DoubleType())]))), "idx")

    return apply


def answer_batch(generate: Generate, question: str, text: str, attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> list[str]:
    """Answers of one batch; too long a batch is halved at an entry, a single entry cut once; rate limits are waited out."""
    tries, cut = 0, False
    while True:
        try:
            return [generate(f"{question}\n\nEntries:\n{text}")]
        except RateLimited as limit:
            tries += 1
            if tries >= attempts:
                raise
            wait(retry_delay(str(limit), 15.0 * tries))
        except Overflow:
            parts = re.split(r"(?m)(?=^### \[)", text)
            parts = [p for p in parts if p]
            if len(parts) > 1:
                half = len(parts) // 2
                return answer_batch(generate, question, "".join(parts[:half]), attempts, wait) + answer_batch(generate, question, "".join(parts[half:]), attempts, wait)
            if cut:
                raise
            text, cut = text[: len(text) // 2], True


def _outcome(answer: str, model: str, batches: list = []) -> dict:  # noqa: B006 - never changed
    totals = {key: sum(b[column] for b in batches) for key, column in (("entries", "entries"), ("tokens_used", "est_tokens"))}
    return dict(answer=answer, model=model, batches=len(batches), **totals)


def answer_corpus(entries: DataFrame, question: str, generate: Generate, sources: set[str] | None = None, max_chars: int = MAX_CHARS, workers: int = 2, model: str = "") -> dict:
    """Map over packed batches, reduce to one answer. ``workers`` bounds the calls at a time (the provider's quota)."""
    rows = entries.where(F.col("source").isin(sorted(sources))) if sources else entries
    if rows.isEmpty():
        return _outcome(NO_ENTRIES, model)
    batches = pack_batches(rows, max_chars)
    outline = manifest_text(rows)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"batch_id": part["batch_id"], "entries": part["entries"], "est_tokens": part["est_tokens"], "answers": [answer_batch(generate, f"{question}\n\nCorpus:\n{outline}", t) for t in part["text"]]})

    mapped = batches.repartition(workers, "batch_id").mapInPandas(run, "batch_id long, entries long, est_tokens long, answers array<string>")
    got = sorted(mapped.collect(), key=lambda r: r.batch_id)  # one answer a batch
    answers = [a for r in got for a in r.answers]
    final = answers[0] if len(answers) == 1 else generate(f"{question}\n\nCombine these partial answers, in order:\n" + "\n---\n".join(answers))
    return _outcome(final, model, got)


def tokens_of(chars: int) -> int:
    return chars // CHARS_PER_TOKEN
