"""Vector formulas on arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def unit(a: Column, least: float = 1e-8) -> Column:
    """a / its length; null if an element is not finite or the length is not above `least`."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & (norm(a) > least), F.transform(a, lambda x: x / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a length is 0; null for different sizes."""
    return F.when(F.size(a) == F.size(b), F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0))


def log_block(a: Column) -> Column:
    """log1p of what is positive, scaled to length 1 (0 stays 0)."""
    return _scaled(F.transform(a, lambda x: F.log1p(F.greatest(x, F.lit(0.0)))))


def signed_log_block(a: Column) -> Column:
    """log1p of the magnitude with the sign, scaled to length 1 (0 stays 0)."""
    return _scaled(F.transform(a, lambda x: F.signum(x) * F.log1p(F.abs(x))))


def _scaled(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(norm(a) > 0, x / norm(a)).otherwise(x))
