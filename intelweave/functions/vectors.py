"""Vector arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    diffs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d * d)


def similarity(dist: Column) -> Column:
    """``max(0, 1 - dist / 2)`` to three digits; the cosine for unit vectors."""
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - dist / F.lit(2.0)), 3)
