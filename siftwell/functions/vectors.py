"""Vector arithmetic on array columns, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vector: Column) -> Column:
    """Euclidean length, 1.0 for an all-zero vector."""
    length = F.sqrt(dot(vector, vector))
    return F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is all zero."""
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def reciprocal_rank(rank: Column, k0: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k0) + rank)
