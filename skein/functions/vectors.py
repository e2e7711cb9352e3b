"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Normalised to length 1; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def fitted(a: Column, dim: int) -> Column:
    """Cut or padded with zeros to ``dim`` components."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), dim)), 1, dim)
