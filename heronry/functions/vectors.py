"""Vector arithmetic on array columns, in doubles so that sums do not depend on float32 rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; null for null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def is_finite(v: Column) -> Column:
    """No element null, NaN or infinite; false for null."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def is_usable(v: Column, width: int) -> Column:
    """``width`` finite elements that are not all zero."""
    return F.coalesce((F.size(v) == width) & is_finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    """Scaled to length 1; vectors that are not finite or all zero stay as they are."""
    n = norm(v)
    return F.when(is_finite(v) & (n > 0), F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def finite_or_null(x: Column) -> Column:
    """A number, or null for what is none, NaN and infinities."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
