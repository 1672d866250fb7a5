"""Vector expressions over arrays; sums run in double precision, in element order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """The vector over its norm, as float; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<float>")).otherwise(F.transform(_doubles(v), lambda x: (x / F.when(n == 0, F.lit(1.0)).otherwise(n)).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column, digits: int = 6) -> Column:
    """Cosine distance, rounded so that order does not hang on the last bits of a sum."""
    return F.round(F.lit(1.0) - cosine(a, b), digits) + F.lit(0.0)


def literal(values) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(x)) for x in values))
