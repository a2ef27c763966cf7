"""Column expressions over vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _let(value: Column, of) -> Column:
    """of(value), with value evaluated once however often of names it: a fold over its one-entry array."""
    return F.transform(F.array(value), of)[0]


def unit(a: Column) -> Column:
    """The vector divided by its norm, which is found once; a zero vector becomes zeros."""
    return _let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """FN4; 0 for empty and zero vectors and for unequal lengths."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), _let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


def mrl(a: Column, dims: int) -> Column:
    """FN19: the first dims components, normalised anew."""
    return unit(F.slice(a, 1, dims))


def defect(a: Column, dims: int) -> Column:
    """FN5: what is wrong with an embedding, null if nothing."""
    return (
        F.when(a.isNull() | (F.size(a) == 0), "empty").when(F.size(a) != dims, "dimension")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), "not_finite").when(norm(a) == 0, "zero_norm")
    )
