"""Arithmetic on array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.functions.scalars import col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` computed once.

    A lambda that mentions an outer expression computes it anew for every
    element; bound to a lambda variable it is a plain value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either has no length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def unit(v: Column) -> Column:
    return let(F.greatest(norm(v), F.lit(1e-8)), lambda n: F.transform(v, lambda x: x / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
