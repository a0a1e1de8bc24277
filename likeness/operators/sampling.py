"""Pair draws. Every draw is a hash taken modulo a dense index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.draws import draw_below
from likeness.operators.ordering import dense_index


def random_pairs(entities: DataFrame, key: str, per_entity: int, seed: str) -> DataFrame:
    """(draw, a, b): ``per_entity`` x n uniform ordered pairs, self-pairs dropped."""
    indexed = dense_index(entities.select(key), key, seed, index="idx", total="n")
    numbered = indexed.select(
        "n", "idx", F.explode(F.sequence(F.lit(0), F.lit(per_entity - 1))).alias("_j")
    ).withColumn("draw", F.col("idx") * per_entity + F.col("_j"))
    draws = numbered.select(
        "draw",
        draw_below(F.col("n"), "draw", seed=f"{seed}L").alias("_l"),
        draw_below(F.col("n"), "draw", seed=f"{seed}R").alias("_r"),
    ).filter("_l <> _r")
    left = indexed.select(F.col("idx").alias("_l"), F.col(key).alias("a"))
    right = indexed.select(F.col("idx").alias("_r"), F.col(key).alias("b"))
    return draws.join(left, "_l").join(right, "_r").select("draw", "a", "b")


def group_pairs(members: DataFrame, group: str, key: str, seed: str, per_member: int = 2) -> DataFrame:
    """(group, draw, a, b): ``per_member`` x n draws with replacement in each group of n >= 2.

    A hot group is numbered in hash buckets and joined on (group, position), so
    it spreads over all tasks. Its draws are numbered from its members, so they are
    made where those lie and no row stands for a whole group.
    """
    indexed = dense_index(members.select(group, key), key, seed, [group], index="idx", total="n").filter("n >= 2")
    turns = F.explode(F.sequence(F.lit(0), F.lit(per_member - 1))).alias("_turn")
    numbered = indexed.select(group, "n", (F.col("idx") * per_member).alias("_first"), turns)
    draws = numbered.withColumn("draw", F.col("_first") + F.col("_turn")).select(
        group,
        "draw",
        draw_below(F.col("n"), group, "draw", seed=f"{seed}L").alias("_l"),
        draw_below(F.col("n"), group, "draw", seed=f"{seed}R").alias("_r"),
    ).filter("_l <> _r")
    left = indexed.select(group, F.col("idx").alias("_l"), F.col(key).alias("a"))
    right = indexed.select(group, F.col("idx").alias("_r"), F.col(key).alias("b"))
    return (
        draws.join(left, [group, "_l"]).join(right, [group, "_r"]).select(group, "draw", "a", "b")
    )
