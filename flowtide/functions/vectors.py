"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def _given(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, not once per array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    """The vector at unit length; an all-zero vector stays as it is."""
    return _given(
        norm(a),
        lambda length: F.when(length > 0, F.transform(_doubles(a), lambda x: x / length)).otherwise(_doubles(a)),
    )


def softmax(logits: Column) -> Column:
    def raised(top: Column) -> Column:
        return F.transform(_doubles(logits), lambda x: F.exp(x - top))

    def shared(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
        return _given(total, lambda t: F.transform(parts, lambda x: x / t))

    return _given(_given(F.array_max(_doubles(logits)), raised), shared)


def argmax(values: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
