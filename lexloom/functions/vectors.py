"""Vectors as arrays of floats, computed in double precision. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector or vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def knn_score(cosine: Column) -> Column:
    """A search index's score of a cosine."""
    return (1 + cosine) / 2


def valid_vector(a: Column, dim: int) -> Column:
    return F.coalesce(a.isNotNull() & (F.size(a) == dim) & F.exists(a, lambda x: x != 0), F.lit(False))


def storage_bytes(n: Column, dim: int) -> Column:
    return n.cast("long") * dim * 4


def seconds_at(n: Column, rate: float) -> Column:
    return n / F.lit(float(rate))
