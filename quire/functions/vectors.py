"""Vectors and sets as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where either vector is zero or they differ in length."""
    size = norm(a) * norm(b)
    return F.when((size == 0) | (F.size(a) != F.size(b)), 0.0).otherwise(dot(a, b) / size)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct runs of k tokens; none of fewer tokens."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(F.size(tokens) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))
