"""Bit arithmetic and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_floor(n: Column) -> Column:
    """BIT-1 (T): -1 for 0; exact, since digits are counted."""
    return F.when(n == 0, -1).otherwise(F.length(F.bin(n)) - 1).cast("int")


def log2_ceiling(n: Column) -> Column:
    """BIT-2 (T): -1 for 0."""
    return F.when(n == 0, -1).otherwise(1 + log2_floor(n - 1)).cast("int")


def is_finite(x: Column) -> Column:
    """FLT-5 (I)."""
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def dot(x: Column, y: Column) -> Column:
    """BLA-1 (M): the inner product of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, v: t + v)


def norm(x: Column) -> Column:
    """BLA-1 (M): Euclidean length."""
    return F.sqrt(dot(x, x))


def scaled(a: float | Column, x: Column) -> Column:
    """BLA-1 (M): a x."""
    return F.transform(x, lambda v: a * v.cast("double"))


def plus_scaled(a: float | Column, x: Column, y: Column) -> Column:
    """BLA-1 (M): a x + y."""
    return F.zip_with(x, y, lambda u, v: a * u.cast("double") + v.cast("double"))
