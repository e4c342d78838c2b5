"""Vector functions as column expressions; sums run in double from left to right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector at length one; a zero vector as it is."""
    column = F.col(v) if isinstance(v, str) else v
    return F.when(norm(column) > 0, F.transform(column, lambda x: (x.cast("double") / norm(column)).cast("float"))).otherwise(column.cast("array<float>"))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
