"""Leakage control: whole groups go to one side."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.draws import digest, hash_bucket
from likeness.operators.ordering import dense_index, running_total


def group_key(expression: Column) -> Column:
    """A group key that never fails: NULL becomes the '' group."""
    return F.coalesce(expression.cast("string"), F.lit(""))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def disjoint_groups(sizes: DataFrame, group: str, fraction: float, seed: str) -> DataFrame:
    """(group, split): groups in hash order go to test until the share is reached.

    A group is taken when the rows before it are still fewer than the target,
    so the last one may overshoot.
    """
    hashed = sizes.withColumn("_hash", digest(group, seed=seed))
    ordered = running_total(
        hashed, [], hash_bucket(F.col("_hash")), ["_hash", group], F.col("size"),
        before="_before", total="_n",
    )
    target = F.floor(F.col("_n") * F.lit(fraction))
    return ordered.select(group, F.when(F.col("_before") < target, 1).otherwise(0).alias("split"))


def group_disjoint_split(df: DataFrame, group: str, fraction: float = 0.2, seed: str = "split") -> DataFrame:
    """Add ``split`` (1 = test). The per-group table is joined back on the group."""
    return df.join(disjoint_groups(group_sizes(df, group), group, fraction, seed), group)


def _fill(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sizes in falling order: how many groups of each size still fit."""
    room = None
    for batch in rows:
        taken = []
        for size, count, n_train in zip(batch["size"], batch["groups"], batch["n_train"]):
            room = n_train if room is None else room
            fit = min(count, room // size)
            room -= fit * size
            taken.append(fit)
        yield pd.DataFrame({"size": batch["size"], "fit": taken})


def first_fit_groups(sizes: DataFrame, group: str, fraction: float = 0.7) -> DataFrame:
    """(group, split): largest groups first, into train while they fit.

    Only the histogram of sizes is walked in order. N rows have at most
    sqrt(2 N) distinct group sizes, so this list is short at any scale; groups
    of one size are told apart by a distributed index.
    """
    histogram = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    n_train = sizes.agg(F.floor(F.sum("size") * F.lit(fraction))).scalar()
    walk = (
        histogram.withColumn("n_train", n_train)
        .repartition(1)
        .sortWithinPartitions(F.desc("size"))
        .mapInPandas(_fill, "size long, fit long")
    )
    indexed = dense_index(sizes, group, "fit", ["size"], index="_pos")
    return indexed.join(walk, "size").select(
        group, F.when(F.col("_pos") < F.col("fit"), 0).otherwise(1).alias("split"))


def split_audit(df: DataFrame, group: str) -> DataFrame:
    """One row: sizes of both sides and the number of groups on both of them."""
    per_group = df.groupBy(group).agg(
        F.count_if(F.col("split") == 0).alias("_train"), F.count_if(F.col("split") == 1).alias("_test"))
    return per_group.agg(
        F.sum("_train").alias("train"), F.sum("_test").alias("test"),
        F.count_if((F.col("_train") > 0) & (F.col("_test") > 0)).alias("leaking_groups"))
