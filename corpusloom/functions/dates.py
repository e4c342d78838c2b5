"""Dates of entries: parsing, age and freshness."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

#: Complete ISO dates, with or without a time and an offset (which is dropped, not converted).
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def with_parsed_dates(df: DataFrame, as_of: datetime | None = None, column: str = "date", out: str = "date_parsed") -> DataFrame:
    """``df`` with its dates as timestamps without a zone; what can't be read is null.

    Complete ISO dates are cast in the JVM. Only rows with another form go through Python, where missing
    parts are filled from ``as_of`` (default: today), so that results don't hang on the clock.
    """
    as_of = (as_of or datetime.now()).replace(hour=0, minute=0, second=0, microsecond=0)
    text = F.trim(F.col(column).cast("string"))
    iso = F.coalesce(text.rlike(ISO), F.lit(False))
    other = F.coalesce(text.rlike(r"[0-9A-Za-z]"), F.lit(False)) & ~iso
    # Offsets are cut off: a cast alone would keep the wall clock only of some forms.
    wall = F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", "")
    wall = F.when(F.length(text) > 10, wall).otherwise(text)
    fast = df.where(~other).withColumn(out, F.when(iso, F.try_cast(wall, "timestamp_ntz")) if hasattr(F, "try_cast") else F.when(iso, wall.try_cast("timestamp_ntz")))
    schema = StructType([*df.schema.fields, StructField(out, TimestampNTZType())])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from dateutil import parser

        def one(value) -> datetime | None:
            try:
                return parser.parse(str(value), fuzzy=True, default=as_of).replace(tzinfo=None)
            except Exception:  # noqa: BLE001 - whatever the parser makes of a strange string, it has no date
                return None

        for batch in batches:
            batch[out] = pd.Series([one(v) for v in batch[column]], index=batch.index, dtype="datetime64[us]")
            yield batch

    variants = [f.name for f in df.schema.fields if f.dataType.typeName() == "variant"]
    if variants:  # not known to Arrow: carried as JSON
        plain = df.where(other)
        for c in variants:
            plain = plain.withColumn(c, F.to_json(c))
        slow = plain.mapInPandas(parse, StructType([*plain.schema.fields, StructField(out, TimestampNTZType())]))
        for c in variants:
            slow = slow.withColumn(c, F.parse_json(c))
    else:
        slow = df.where(other).mapInPandas(parse, schema)
    return fast.unionByName(slow)


def age_days(date: Column | str, as_of: datetime) -> Column:
    """Whole days since, rounded down (a difference of dates would count midnights)."""
    date = F.col(date) if isinstance(date, str) else date
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return F.floor((micros(F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")) - micros(date)) / F.lit(86_400_000_000))


def check_half_lives(half_lives: dict[str, float | None] | None) -> dict[str, float | None]:
    for source, days in (half_lives or {}).items():
        if days is not None and days <= 0:
            raise ValueError(f"half-life of {source!r} must be positive")
    return dict(half_lives or {})


def freshness(as_of: datetime, half_lives: dict[str, float | None] | None = None, default: float = 365.0, source: str = "source", date: str = "date_parsed") -> Column:
    """Sources whose half-life is None never age (1.0, even undated); undated entries have 0.5; from ``as_of`` on 1.0; else halves per half-life."""
    half_lives = check_half_lives(half_lives)
    ageless = [s for s, d in half_lives.items() if d is None]
    timed = {s: d for s, d in half_lives.items() if d is not None}
    days = F.lit(float(default))
    if timed:
        own = F.create_map(*[F.lit(x) for s, d in timed.items() for x in (s, float(d))])
        days = F.coalesce(own[F.col(source)], days)
    age = age_days(date, as_of)
    value = F.when(F.col(date).isNull(), 0.5).when(age <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / days))
    return F.when(F.col(source).isin(ageless), 1.0).otherwise(value) if ageless else value
