"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import _col, let


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    size = let(norm(a), lambda z: F.when(z > 0, z).otherwise(F.lit(1.0)))
    # the length is bound once; inside the element function it would be computed per element
    return let(size, lambda z: F.transform(_col(a), lambda x: x.cast("double") / z))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x)


def best_vector(*candidates: Column | str) -> Column:
    """The most reduced vector a row has."""
    return F.coalesce(*[_col(c) for c in candidates])
