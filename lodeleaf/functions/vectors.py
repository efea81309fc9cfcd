"""Column functions on vectors (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Null where the sizes differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(v: Column) -> Column:
    """L2 norm; 1 for a zero vector."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def normalised(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def usable(v: Column, dim: Column) -> Column:
    """Of the right size, finite and not all zero."""
    fit = v.isNotNull() & (F.size(v) == dim) & (dim > 0)
    return fit & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
