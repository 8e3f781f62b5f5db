"""Numbers as column expressions: decimals, clamps, distances, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_decimal(value: Column) -> Column:
    """A decimal as text: no exponent, no zeros at the end of its fraction, "0" for zero."""
    text = F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1")
    text = F.regexp_replace(text, r"\.$", "")
    return F.when(text.rlike(r"^-?0$"), F.lit("0")).otherwise(text)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole within 0 and 1, rounded; 0 where whole is 0."""
    return F.round(F.when(whole == 0, F.lit(0.0)).otherwise(clamp(part / whole)), digits)


def distance_score(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where sizes differ or a vector is empty or all zero."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (lengths == 0), F.lit(0.0)).otherwise(dot(a, b) / lengths)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def unit_vector(a: Column) -> Column:
    """The vector at length 1; null where it has no length."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x / length).cast("float")))
