"""Vector functions over ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; different sizes or a zero vector are errors, as they are data faults."""
    size = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in size"))
    length = norm(a) * norm(b)
    zero = F.assert_true(length > 0, F.lit("zero vector"))
    return F.when(size.isNull() & zero.isNull(), dot(a, b) / length)
