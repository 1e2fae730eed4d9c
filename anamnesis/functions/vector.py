"""Vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarities are rounded to this many digits wherever they are produced, so
# thresholds and rankings do not depend on the order of a floating-point sum.
SIM_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays zero."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: F.lit(0.0))).otherwise(
        F.transform(a, lambda x: x.cast("double") / length)
    )


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two unit vectors, one pass over the pair."""
    return F.round(dot(a, b), SIM_DIGITS)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector gives 0, unequal lengths are an error."""
    scale = norm(a) * norm(b)
    value = F.when(scale == 0, F.lit(0.0)).otherwise(F.round(dot(a, b) / scale, SIM_DIGITS))
    mismatch = F.raise_error(F.lit("vectors differ in length")).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(F.size(a) != F.size(b), mismatch).otherwise(value)
    )
