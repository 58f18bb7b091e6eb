"""Distances between dense vectors, as expressions over arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """1 less the cosine; null where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - dot(a, b) / F.nullif(norms, F.lit(0.0))


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)))


def inner(a: Column, b: Column) -> Column:
    """1 less the inner product."""
    return F.lit(1.0) - dot(a, b)


METRICS = {"cosine": cosine, "l2sq": l2sq, "ip": inner}
