"""Vector expressions over arrays; null where a side is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(terms: Column, width: int = 64) -> Column:
    """Counts of terms in width places given by their hash: a vector for texts where no model is at hand."""
    places = F.transform(terms, lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long") % width).cast("int"))
    return F.get(F.transform(F.array(places), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(all_, lambda x: x == i)).cast("double"))), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def finite(a: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; false for null."""
    return F.coalesce(F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
