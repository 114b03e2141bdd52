"""Vector expressions; arrays of float or double, computed as double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for a vector without length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def is_finite(a: Column, dimensions: int) -> Column:
    """Of this size, and with finite numbers only."""
    odd = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (F.size(a) == dimensions) & ~odd
