"""From curated records to one graded call per (entity, target)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.functions.scalars import grade_ramp
from likeness.sources.tables import dealt, tasks_for

MAX_SPREAD = 1.0
INACTIVE = 4.5


def replicate_stats(exact: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, min, max and size per group.

    Equal values are counted first, so a group's share of a task is its number
    of distinct values. The median is read off the running count: the window
    and the aggregate after it use one partitioning, and both spill.
    """
    counted = exact.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(group)})
    middle = (F.col("_upto") * 2 >= F.col("_all")) & ((F.col("_upto") - F.col("_n")) * 2 <= F.col("_all"))
    return run.groupBy(*keys).agg(
        ((F.min(F.when(middle, F.col(value))) + F.max(F.when(middle, F.col(value)))) / 2.0).alias("median"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.sum("_n").alias("size"),
    )


def spread_filter(stats: DataFrame, limit: float = MAX_SPREAD) -> DataFrame:
    return stats.filter(F.col("high") - F.col("low") <= limit)


def best_evidence(stats: DataFrame, keys: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    """The largest group of each key. An aggregate, so it combines map-side."""
    order = F.struct("size", *tie_break)
    kept = ["median", "size", *tie_break]
    return stats.groupBy(*keys).agg(
        F.max_by(F.struct(*kept), order).alias("_best")
    ).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in kept])


def censored_bounds(censored: DataFrame, keys: Sequence[str], limit: float = INACTIVE) -> DataFrame:
    """The loosest bound of each pair, kept when even that one says inactive."""
    return (
        censored.groupBy(*keys)
        .agg(F.max("bound").alias("bound"))
        .filter(F.col("bound") <= limit)
    )


def first_source(df: DataFrame, keys: Sequence[str], precedence: Column | str) -> DataFrame:
    """One row per key: the one whose source comes first; of equal sources, the least row."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.col(precedence) if isinstance(precedence, str) else precedence
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(rank, *rest)).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
    )


def activity_calls(
    exact: DataFrame,
    censored: DataFrame,
    value: str = "potency",
    pair: Sequence[str] = ("entity", "target"),
    conditions: Sequence[str] = ("type", "ach"),
) -> DataFrame:
    """(entity, target, value, source): graded exact calls, then bounds at -1.

    Records are dealt by pair, all that follows lies with its pair, and tasks
    become more with the records and not larger.
    """
    tasks = tasks_for(exact, censored)
    exact, censored = dealt(exact, tasks, *pair), dealt(censored, tasks, *pair)
    stats = spread_filter(replicate_stats(exact, [*pair, *conditions], value))
    graded = best_evidence(stats, pair, conditions).select(
        *pair, grade_ramp("median").alias("_exact"))
    bounds = censored_bounds(censored, pair).select(*pair, F.lit(None).cast("double").alias("_exact"))
    # Both sides hold a pair once, so the exact value is the maximum of one.
    both = graded.unionByName(bounds).groupBy(*pair).agg(F.max("_exact").alias("_exact"))
    source = F.when(F.col("_exact").isNotNull(), "exact").otherwise("censored")
    return both.select(*pair, F.coalesce("_exact", F.lit(-1.0)).alias("value"), source.alias("source"))


def min_group(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Rows of the keys that have at least ``at_least`` rows."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return df.join(enough, key, "left_semi")


def annotation_histogram(calls: DataFrame, entity: str = "entity") -> DataFrame:
    """Entities by number of targets, in six classes."""
    sizes = calls.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    label = (
        F.when(n == 1, "1").when(n == 2, "2").when(n <= 4, "3-4")
        .when(n <= 9, "5-9").when(n <= 19, "10-19").otherwise("20+")
    )
    return sizes.groupBy(label.alias("targets")).agg(F.count(F.lit(1)).alias("entities"))
