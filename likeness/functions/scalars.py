"""Scalar transforms used by curation, grading and scoring."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def conditions_hash(*fields: Column | str) -> Column:
    """16 hex characters naming a set of conditions; a NULL field counts as ''."""
    filled = [F.coalesce(col(f).cast("string"), F.lit("")) for f in fields]
    return F.substring(F.md5(F.concat_ws("|", *filled)), 1, 16)


def null_safe_not_in(comment: Column | str, listed: Iterable[str]) -> Column:
    c = col(comment)
    return c.isNull() | ~F.lower(c).isin(*listed)


def bound_from_value(nanomolar: Column | str) -> Column:
    return F.lit(9.0) - F.log10(col(nanomolar))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def grade_ramp(potency: Column | str, inactive: float = 4.5, active: float = 6.0) -> Column:
    """Potency to [-1, 1]: flat outside the two limits, linear between them."""
    share = (col(potency) - F.lit(inactive)) / F.lit(active - inactive)
    return F.lit(2.0) * clip(share, 0.0, 1.0) - F.lit(1.0)


def log_floor(value: Column | str) -> Column:
    """log10 with everything below 1e-6 raised to it."""
    return F.log10(F.greatest(col(value), F.lit(1e-6)))


def log_positive(value: Column | str) -> Column:
    """log10 of positive values; the others stay as they are."""
    v = col(value)
    return F.when(v > 0, F.log10(F.greatest(v, F.lit(1e-12)))).otherwise(v)


def log_plus_one(value: Column | str) -> Column:
    """log10(max(v, 0) + 1)."""
    return F.log10(F.greatest(col(value), F.lit(0.0)) + F.lit(1.0))


def finite(value: Column | str) -> Column:
    """The value as a double, or NULL when it is no finite number."""
    v = col(value).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def extract_number(text: Column | str) -> Column:
    """The first run of digits and points, as a double (NULL when unreadable)."""
    return F.nullif(F.regexp_extract(col(text), "([0-9.]+)", 1), F.lit("")).try_cast("double")


def sanitise(value: Column | str, limit: float = 1e12) -> Column:
    """NULL, NaN and infinities become 0; the rest is clipped to +-limit."""
    return clip(F.coalesce(finite(value), F.lit(0.0)), -limit, limit)


def distance_to_similarity(distance: Column | str, gamma: float = 4.0) -> Column:
    """exp(-gamma d): 1 for identical; NULL and NaN stay what they are."""
    return F.exp(F.lit(-float(gamma)) * col(distance))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL where bottom is 0."""
    return top / F.nullif(bottom, F.lit(0.0))
