"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; a zero vector gives 0. Pass norms that are already columns to compute them once a vector."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    return dot(a, b) / (F.greatest(na, F.lit(EPSILON)) * F.greatest(nb, F.lit(EPSILON)))


def l2_normalise(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(EPSILON)))


def pad_or_cut(v: Column, size: int) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def even_indices(first: Column, last: Column, n: int) -> Column:
    """``n`` whole numbers spread evenly from first to last, rounded down."""
    if n == 1:
        return F.array(first.cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(first + i * (last - first) / (n - 1)).cast("int"))
