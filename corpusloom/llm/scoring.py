"""Fetching labelled samples and mapping whole texts with what was trained on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

TYPES = {"double": (DoubleType(), pa.float64()), "long": (LongType(), pa.int64()), "int": (IntegerType(), pa.int32()), "string": (StringType(), pa.string())}
#: Texts that are turned into Python strings at a time.
AT_ONCE = 512


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most_rows: int) -> pd.DataFrame:
    """(doc_id, text, label) of at most ``most_rows`` usable labelled documents, each label at most half of them.

    They are chosen by the hash of their id, so the sample is the same at every run. Labels other than 0 and
    1 are left out; of labels that repeat an id, the highest counts, and of texts, the least.
    """
    known = labels.where(F.col(label).isin(0, 1)).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(label).alias("label")).where(usable)
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows // 2) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id", kind="stable")


def map_texts(docs: DataFrame, text: str, keep: list[str], added: dict[str, str], start: Callable[[], Callable[[list[str | None]], list[list]]]) -> DataFrame:
    """The columns to keep and those that a function adds to each text.

    ``start`` is called once a partition and gives the function: from some texts (null as None) to one list of values for
    each added column. The columns kept stay in Arrow, so that numbers beside nulls keep their type and value. A kept
    column whose name is that of an added one, in any case, is left out.
    """
    taken = {c.lower() for c in added}
    keep = [c for c in keep if c.lower() not in taken]
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("text of " + "_".join(keep)))
    kinds = [TYPES[k][1] for k in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                found = work(some.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))], names=[*keep, *added])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[: len(keep)], *(StructField(c, TYPES[k][0]) for c, k in added.items())]))


def score_texts(docs: DataFrame, model, *, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) and a score of each whole text.

    ``model.scores(texts, cache)`` gives one number a text; the cache lives as long as a partition is read. An existing
    column of the score's name is replaced. Null texts are passed as they come; models read them as empty. Rows that
    repeat are scored alike, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        cache: dict = {}
        return lambda texts: [shared.value.scores(texts, cache).tolist()]

    return map_texts(docs, text, docs.columns if keep is None else keep, {score: "double"}, start)
