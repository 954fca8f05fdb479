"""Vector arithmetic as Spark expressions, in double precision over arrays of any number type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column | str) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if either vector is null or their lengths differ."""
    pairs = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - a.b / (|a| |b|); null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1.0 - dot(a, b) / size)


def squared_euclidean(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column | str) -> Column:
    """The vector at length 1; null for a zero vector."""
    size = norm(a)
    return F.when(size > 0, F.transform(_doubles(a), lambda x: x / size))
