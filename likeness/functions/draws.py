"""Reproducible draws: every random choice is a hash of the key and a seed.

A draw depends on the row alone, so it is the same for any partitioning, any
retry of a lost task and any engine that has MD5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_HEX = 3  # 16**3 = 4096 order-preserving buckets of a hash


def digest(*parts: Column | str, seed: str | int | None = None) -> Column:
    """MD5 of the parts joined by a bar (32 hex characters)."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    columns = [c.cast("string") for c in columns]
    if seed is not None:
        columns.append(F.lit(str(seed)))
    return F.md5(F.concat_ws("|", *columns))


def uint32(hex_digest: Column) -> Column:
    """The first eight hex characters as a number in [0, 2**32)."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def draw_uint(*parts: Column | str, seed: str | int | None = None) -> Column:
    """A uniform number in [0, 2**60), so that a modulus reaches the rows of any table."""
    return F.conv(F.substring(digest(*parts, seed=seed), 1, 15), 16, 10).cast("long")


def draw_below(n: Column, *parts: Column | str, seed: str | int | None = None) -> Column:
    """A uniform draw in [0, n)."""
    return F.pmod(draw_uint(*parts, seed=seed), n)


def hash_bucket(hex_digest: Column) -> Column:
    """Order-preserving bucket of a digest, for a distributed sort by hash."""
    return F.substring(hex_digest, 1, BUCKET_HEX)
