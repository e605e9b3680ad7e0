"""Vector functions on array<float> columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vector(v: Column | Sequence[float]) -> Column:
    """A column, or a constant vector folded from one literal."""
    if isinstance(v, Column):
        return v
    return F.split(F.lit(",".join(repr(float(x)) for x in v)), ",").cast("array<double>") if len(v) else F.array().cast("array<double>")


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(a, _vector(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    # the outer transform only binds the norm, so that it isn't worked out for each component
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))
    return F.element_at(scaled, 1)


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """0 where lengths differ, a vector is empty or has no length."""
    v = _vector(b)
    scale = norm(a) * norm(v)
    return F.when((F.size(a) == F.size(v)) & (F.size(a) > 0) & (scale > 0), dot(a, v) / scale).otherwise(F.lit(0.0))


def quantised(a: Column) -> Column:
    """Components of a unit vector as whole numbers from -127 to 127."""
    return F.transform(a, lambda x: F.round(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 127).cast("tinyint"))


def quantised_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(127.0 * 127.0)
