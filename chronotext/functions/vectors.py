"""Vectors held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(v: Column) -> Column:
    n = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / n)


def mean_vector(v: str, size: int) -> Column:
    """Aggregate: the mean of arrays of ``size`` numbers, element by element."""
    return F.array(*[F.avg(F.col(v)[i].cast("double")) for i in range(size)])
