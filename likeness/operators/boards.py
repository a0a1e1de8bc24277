"""Leaderboards: where a score would be placed, and tables over many results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.operators.ordering import quantile, running_total, with_bucket


def rank_against_board(entrants: DataFrame, board: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Add rank (1 + strictly lower board values), percentile and finalists.

    Both sides are counted on the same values and one running count answers
    every entrant: there is no join on inequality.
    """
    keys = list(keys)
    stacked = board.select(*keys, value, F.lit(1).alias("_board")).unionByName(
        entrants.select(*keys, value, F.lit(0).alias("_board")))
    counted = stacked.groupBy(*keys, value).agg(F.sum("_board").alias("_n"))
    below = running_total(with_bucket(counted, value), keys, F.col("_value_bucket"), [value], F.col("_n"),
                          before="_below", total="finalists")
    placed = entrants.join(below.select(*keys, value, "_below", "finalists"), [*keys, value])
    return placed.withColumn("rank", F.col("_below") + 1).withColumn(
        "percentile", 100.0 * F.col("_below") / F.nullif(F.col("finalists"), F.lit(0))).drop("_below")


def board_summary(board: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    ends = board.groupBy(*keys).agg(
        F.min(value).alias("winner"), F.max(value).alias("last"), F.count(value).alias("entrants"))
    return ends.join(quantile(board, keys, value, 0.5, "median"), list(keys))


def macro_average(scores: DataFrame, model: str, value: str) -> DataFrame:
    """Unweighted mean over endpoints."""
    return scores.groupBy(model).agg(F.avg(value).alias(value))


def placement_table(
    entrants: DataFrame, boards: DataFrame, overall: DataFrame, model: str, endpoint: str, value: str = "value"
) -> DataFrame:
    """Per endpoint and, as endpoint ``macro``, per model over all of them.

    ``best`` and ``worst`` are the extreme endpoint ranks of the model.
    """
    per_endpoint = rank_against_board(entrants, boards, [endpoint], value)
    ends = per_endpoint.groupBy(model).agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))
    macro = macro_average(entrants, model, value).withColumn(endpoint, F.lit("macro"))
    overall = overall.select(F.col(value), F.lit("macro").alias(endpoint))
    tidy = per_endpoint.unionByName(rank_against_board(macro, overall, [endpoint], value))
    return tidy.join(ends, model)


def finite_mean(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of the finite entries; NaN, infinities and NULL do not count."""
    return df.filter(F.abs(F.col(value).cast("double")) < float("inf")).groupBy(*keys).agg(F.avg(value).alias(out))


def head_to_head(metrics: DataFrame, baseline: str, cell: Sequence[str]) -> DataFrame:
    """(method, wins, total, delta) against a baseline where both have a value."""
    usable = metrics.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    base = usable.filter(F.col("method") == baseline).select(*cell, F.col("value").alias("_base"))
    gap = F.col("value") - F.col("_base")
    return (
        usable.filter(F.col("method") != baseline).join(base, list(cell)).groupBy("method")
        .agg(F.count_if(gap > 0).alias("wins"), F.count(F.lit(1)).alias("total"), F.avg(gap).alias("delta"))
    )


def paired_delta(first: DataFrame, second: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Mean of second - first per method over the cells both hold."""
    other = second.select(*cell, "method", F.col("value").alias("_other"))
    return first.join(other, [*cell, "method"]).groupBy("method").agg(
        F.avg(F.col("_other") - F.col("value")).alias("delta"), F.count(F.lit(1)).alias("cells"))


def best_method(metrics: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Mark the methods that reach the highest value of their cell."""
    top = F.max("value").over(Window.partitionBy(*cell))
    return metrics.withColumn("best", F.col("value") == top)


def ordered_panel(metrics: DataFrame, baseline: str, cell: Sequence[str]) -> DataFrame:
    """Methods in rising order within each cell, with the baseline's value beside."""
    order = Window.partitionBy(*cell).orderBy("value", "method")
    base = metrics.filter(F.col("method") == baseline).select(*cell, F.col("value").alias("reference"))
    return metrics.withColumn("place", F.row_number().over(order)).join(base, list(cell), "left")


def suite_table(metrics: DataFrame, row: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """One row per endpoint, one column per method, and a row ``mean`` below."""
    wide = metrics.groupBy(*row).pivot("method", list(methods)).agg(F.first("value"))
    mean = finite_mean(metrics, ["method"], "value", "value")
    last = mean.groupBy().pivot("method", list(methods)).agg(F.first("value"))
    return wide.unionByName(last.select(*[F.lit("mean").alias(c) for c in row], *methods))
