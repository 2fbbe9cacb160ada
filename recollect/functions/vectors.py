"""Vector functions on array<float> columns, computed in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null, of another length, or zero."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(doubles(a), lambda v: F.when(n > 0, v / n).otherwise(v))


def padded(a: Column, size: int) -> Column:
    """Zeros appended up to the size."""
    return F.concat(doubles(a), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def edge_weight(similarity: Column, a: Column, b: Column) -> Column:
    """0.7 * similarity + 0.3 * share of the smaller concept set that the other has; an empty set shares nothing."""
    least = F.least(F.size(a), F.size(b))
    return 0.7 * similarity + 0.3 * F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def letters(x: Column) -> Column:
    """How often each of 26 Latin letters and of a few frequent Han characters stands in a text: a vector that needs no model."""
    low = F.lower(x)
    # by bytes: unlike characters, these need not be counted
    return F.array(*(((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c), F.lit("")))) / len(c.encode())).cast("double") for c in LETTERS))


#: The characters that ``letters`` counts.
LETTERS = "abcdefghijklmnopqrstuvwxyz的一不是了有在人药血天医"
