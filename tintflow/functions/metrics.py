"""Sums of squares and squared distances."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_of_squares(components: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("double") * c.cast("double") for c in components])


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Of whole numbers it is a whole number."""
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)])


def squared_distance_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
