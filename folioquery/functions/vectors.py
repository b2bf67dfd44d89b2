"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns.

They are meant for one vector or one pair per row. Many-to-many similarity goes
through operators/similarity.py, which multiplies blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(_double(vector), F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(vector)
    # The length is bound once per row, not once per element.
    scaled = F.transform(
        F.array(length), lambda n: F.transform(_double(vector), lambda x: F.when(n == 0, x).otherwise(x / n))
    )
    return F.element_at(scaled, 1)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when one side is a zero vector."""
    lengths = norm(a) * norm(b)
    return F.when(lengths != 0, dot(a, b) / lengths)


def _plain_number(x: Column) -> Column:
    """Shortest decimal form without exponent and without a trailing `.0`."""
    text = x.cast("string")
    expanded = F.regexp_replace(text.try_cast("decimal(38,30)").cast("string"), "0+\\z", "")
    return F.regexp_replace(F.when(F.contains(text, F.lit("E")), expanded).otherwise(text), "\\.0?\\z", "")


def vector_to_text(vector: Column) -> Column:
    """Text literal of a vector: `[0.5,-1,0.0001]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, _plain_number), ","), F.lit("]"))


def vector_from_text(text: Column) -> Column:
    return F.from_json(text, "array<double>").cast("array<float>")
