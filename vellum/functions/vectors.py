"""Distances between float arrays, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences in double precision."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
