"""Query op10: personal data in all documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .scoring import map_texts
from .shared import table

NAME = "op10_pii"
COLUMNS = {"n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_sha256": "string", "spans": "string"}
#: The field learns from at most so many texts, of so many characters together. Its labels are the patterns' own finds.
TRAIN_ROWS = 2000
TRAIN_CHARS = 20_000_000


def fitted(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> pii.Field:
    """The field, trained on texts that hold a digit, ``@`` or ``+``, in order of the hash of their id, up to both bounds.

    Rows that repeat an id and a text count once. Where no text qualifies, the field finds nothing.
    """
    usable = docs.where(F.col("text").rlike("[0-9@+]")).select("doc_id", "text", F.xxhash64("text").alias("hash"))
    # The ids are chosen first, so that no task sends texts that are not.
    first = usable.select("doc_id", "hash", F.char_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(rows).collect()
    chosen, total = [], 0
    for r in dict.fromkeys((r.doc_id, r.hash, r.n) for r in first):
        if total + r[2] > chars:
            break
        total += r[2]
        chosen.append(r[:2])
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, hash long")
    one = usable.alias("u").join(F.broadcast(ids).alias("i"), F.expr("u.doc_id <=> i.doc_id AND u.hash = i.hash")).groupBy("u.doc_id", "u.hash").agg(F.min("u.text").alias("text"))
    return pii.train(r.text for r in sorted(one.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.hash)))


def joined(spans: list[pii.Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str | None, spans: list[pii.Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap as one, under the kind of the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def redact_rows(docs: DataFrame, model: pii.Field) -> DataFrame:
    """``docs`` with ``text`` redacted, and ``n_chars``, where there is one, set to match in the rows that change.

    Null texts stay null, every other column stays as it is, and rows that repeat are redacted alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    masked, length = (next(c for c in (name + "_" * n for n in range(len(docs.columns) + 1)) if c.lower() not in {x.lower() for x in docs.columns}) for name in ("masked", "masked_length"))

    def start():
        def work(texts: list[str | None]) -> list[list]:
            found = [redacted(t, pii.find(t, shared.value)[1]) for t in texts]
            return [found, [None if new is old else len(new) for new, old in zip(found, texts, strict=True)]]

        return work

    out = map_texts(docs, "text", [c for c in docs.columns if c != "text"], {masked: "string", length: "long"}, start)
    new = {"text": F.col(masked), "n_chars": F.coalesce(F.col(length), F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else out[f"`{f.name}`"] for f in docs.schema])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are read as empty; every row of the table gives one, repeats and null ids included; an empty table none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = spark.sparkContext.broadcast(fitted(docs))

    def start():
        def work(texts: list[str | None]) -> list[list]:
            out = []
            for text in texts:
                base, both = pii.find(text, model.value)
                out.append((*(sum(s[0] == kind for s in base) for kind in pii.KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both)))
            return list(zip(*out, strict=True))

        return work

    return map_texts(docs, "text", ["doc_id"], COLUMNS, start)
