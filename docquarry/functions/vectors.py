"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.common import as_column, let


def as_doubles(vector: str | Column) -> Column:
    return as_column(vector).cast("array<double>")


def inner_product(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, inner_product(a, b) / scale).otherwise(F.lit(0.0))


def l2_distance(a: str | Column, b: str | Column) -> Column:
    squares = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(vector: str | Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return let(
        as_doubles(vector),
        lambda v: let(
            F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)),
            lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v),
        ),
    )


def cut_dimensions(vector: str | Column, dimensions: int | None) -> Column:
    """First ``dimensions`` values when that is fewer than there are; no new normalisation."""
    return F.slice(as_column(vector), 1, dimensions) if dimensions else as_column(vector)


def fit_dimensions(vector: str | Column, dimensions: int | None) -> Column:
    """Cut or pad with zeros to exactly ``dimensions``; null or 0 leaves the vector unchanged."""
    vector = as_column(vector)
    if not dimensions:
        return vector
    missing = F.greatest(F.lit(dimensions) - F.size(vector), F.lit(0))
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), missing)), 1, dimensions)


def yes_probability(no_logit: str | Column, yes_logit: str | Column) -> Column:
    """Softmax probability of the second of two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(as_column(no_logit) - as_column(yes_logit)))
