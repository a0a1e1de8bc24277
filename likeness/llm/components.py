"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.stores import Workspace


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node of u's neighbourhood, u included.

    The least is aggregated before the join, so a node with very many
    neighbours is one row on the small side and is split on the large one.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(ws: Workspace, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the least node reachable; nodes without an edge are left out.

    Large star: every larger neighbour moves to the least of the neighbourhood.
    Small star: the smaller neighbours and the node itself do. Both keep the
    components, and at the fixed point every node hangs on its root.
    """
    def pairs(df):
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    current = ws.write(pairs(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    state = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if seen == state or not seen["n"]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select("v", "v")).distinct()
        state = seen
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.write(pairs(large), "large")
        # In a table of (larger, smaller) rows the smaller neighbours of u are its rows.
        small = _least(large).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        following = ws.write(pairs(small), "small")
        ws.drop(current, large)
        current = following
