"""Ranks, positions and quantiles that no single task has to hold.

A window without partition keys, or with one hot key, sorts everything in one
task. Here each ordering is cut into buckets that follow the order (a bucket
never spans another), the bucket totals are prefix-summed, and only the rest of
the running sum is windowed inside a bucket. The bucket is a function of the
row's value, so both passes agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.functions.draws import digest, hash_bucket

#: Hexadecimal digits of the hash prefix by which ``sample_n`` counts.
CUT_HEX = 4

#: Buckets that an ordering is cut into; a power of two.
BUCKETS = 1024
#: Hexadecimal digits of a tie hash by which a value at an edge is cut again.
TIE_HEX = 2


def with_bucket(df: DataFrame, value: str, out: str = "_value_bucket", tie: Column | None = None) -> DataFrame:
    """Add a monotone bucket of each value, with about as many rows of ``df`` in each.

    The edges come from one mergeable sketch of the values, whatever their
    magnitude or range: a scalar subquery of BUCKETS - 1 numbers. A bucket may be
    larger than the others by the sketch's error or where one value repeats.
    NULL has no bucket; NaN is above every number. With ``tie`` (a hexadecimal
    digest) buckets follow (value, tie), and a value that is an edge, as a frequent
    one is, has a bucket for each of its digests' prefixes.
    """
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    v = F.col(value).cast("double")
    edges = F.col("_edges")
    marked = df.withColumn("_edges", df.agg(F.percentile_approx(v, shares, 10 * BUCKETS)).scalar())
    steps = F.array(*[F.lit(BUCKETS >> i) for i in range(1, BUCKETS.bit_length())])
    # How many edges are not above the value, by halving.
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (n + step <= F.size(edges)) & (F.get(edges, n + step - 1) <= v), n + step).otherwise(n))
    if tie is not None:
        ties = 16 ** TIE_HEX
        at_edge = F.get(edges, F.col("_below") - 1) == v  # the first values of their bucket
        prefix = F.conv(F.substring(tie, 1, TIE_HEX), 16, 10).cast("int")
        marked, below = marked.withColumn("_below", below), F.col("_below") * (ties + 1) + F.when(at_edge, prefix).otherwise(ties)
    return marked.withColumn(out, F.when(v.isNotNull(), below).cast("long")).drop("_edges", "_below")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    weight: Column,
    before: str = "before",
    total: str | None = None,
) -> DataFrame:
    """Add ``before``: the weight of the rows ahead of this one within its keys.

    ``bucket`` must be monotone in ``order``. The table of bucket totals has at
    most keys x buckets rows, and the first window runs on it only.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket).withColumn("_weight", weight.cast("long"))
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_sum"))
    group = Window.partitionBy(*keys)
    ahead = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"),
        *([F.sum("_sum").over(group).alias(total)] if total else []),
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_local", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(before, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_weight", "_local", "_offset")
    )


def dense_index(
    df: DataFrame,
    key: str | Sequence[str],
    seed: str | int,
    keys: Sequence[str] = (),
    index: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Number the rows 0, 1, ... within ``keys`` in the hash order of ``key``.

    ``key`` must be unique within ``keys``.
    """
    parts = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_hash", digest(*parts, seed=seed))
    return running_total(
        hashed,
        keys,
        hash_bucket(F.col("_hash")),
        ["_hash", *parts],
        F.lit(1),
        before=index,
        total=total,
    ).drop("_hash")


def sample_n(
    df: DataFrame, key: str | Sequence[str], n: int, seed: str | int, keys: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``n`` rows (per ``keys``) without replacement, by hash order; ``key`` is unique within ``keys``.

    Two passes: rows per hash prefix are counted, and the prefix is found that
    the n-th row has. Rows with a smaller prefix are taken where they lie; only
    those of the one prefix at the edge are put in order.
    """
    parts, keys = [key] if isinstance(key, str) else list(key), list(keys)
    hashed = df.withColumn("_hash", digest(*parts, seed=seed))
    prefix = F.substring("_hash", 1, CUT_HEX)
    counted = hashed.groupBy(*keys, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*keys).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = counted.withColumn("_to", F.sum("_n").over(up_to)).filter(F.col("_to") - F.col("_n") < n).groupBy(*keys).agg(
        F.max("_prefix").alias("_edge"), (F.lit(n) - F.max(F.col("_to") - F.col("_n"))).alias("_room"))
    joined = hashed.join(edge, keys) if keys else hashed.crossJoin(F.broadcast(edge))  # without keys the edge is one row
    taken = joined.filter(prefix < F.col("_edge")).select(*df.columns)
    order = Window.partitionBy(*keys).orderBy("_hash", *parts)
    last = joined.filter(prefix == F.col("_edge")).withColumn("_pos", F.row_number().over(order)).filter(
        F.col("_pos") <= F.col("_room")).select(*df.columns)
    return taken.unionByName(last)


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[Column] = ()
) -> DataFrame:
    """Tie-averaged ranks of the distinct values within ``keys``.

    Rows collapse to one row per (keys, value) before anything is ordered, so a
    value that a third of the rows share costs one row. Output: keys, value,
    ``n`` rows, ``before`` rows below, ``avg_rank``, ``total`` rows, and any
    extra ``sums`` taken over the collapsed rows.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *sums)
    ranked = running_total(
        with_bucket(counted, value), keys, F.col("_value_bucket"), [value], F.col("n"), total="total"
    ).drop("_value_bucket")
    return ranked.withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))


def quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile"
) -> DataFrame:
    """Exact quantile with linear interpolation, one row per ``keys``."""
    ranked = value_ranks(df.filter(F.col(value).isNotNull()), keys, value)
    position = (F.col("total") - 1) * F.lit(float(q))
    low, high = F.floor(position), F.ceil(position)
    covers = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("n"))
    return (
        ranked.filter(covers(low) | covers(high))
        .groupBy(*keys)
        .agg(
            F.min(value).alias("_lo"),
            F.max(value).alias("_hi"),
            F.max(position - low).alias("_part"),
        )
        .withColumn(out, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
        .drop("_lo", "_hi", "_part")
    )


def top_fraction(
    df: DataFrame, keys: Sequence[str], score: str, key: str, frac: float, out: str = "in_top"
) -> DataFrame:
    """Flag the best max(1, round(frac * n)) rows per ``keys``; ties by key hash.

    The score at the edge is found on the collapsed values; only the rows tied
    with it are put in hash order.
    """
    k = F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(frac)).cast("long"))
    flipped = df.withColumn("_neg", -F.col(score))
    edge = (
        value_ranks(flipped, keys, "_neg")
        .withColumn("_k", k)
        .filter((F.col("before") < F.col("_k")) & (F.col("before") + F.col("n") >= F.col("_k")))
        .select(*keys, F.col("_neg").alias("_edge"), (F.col("_k") - F.col("before")).alias("_room"))
    )
    joined = flipped.join(edge, list(keys))
    tied = joined.filter(F.col("_neg") == F.col("_edge"))
    chosen = dense_index(tied, key, "top", keys, index="_pos").select(
        *df.columns, (F.col("_pos") < F.col("_room")).alias(out)
    )
    rest = joined.filter(F.col("_neg") != F.col("_edge")).select(
        *df.columns, (F.col("_neg") < F.col("_edge")).alias(out)
    )
    return rest.unionByName(chosen)
