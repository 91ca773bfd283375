"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of the products; null if either vector is null or their lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity. Zero, NaN and unequal vectors have -2, below any other, so that they rank last."""
    size = norm(a) * norm(b)
    return F.coalesce(F.nanvl(F.when(size > 0, dot(a, b) / size), F.lit(-2.0)), F.lit(-2.0))


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant of the plan."""
    return F.array(*[F.lit(float(x)) for x in vector])
