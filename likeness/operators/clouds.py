"""Clouds of typed points, their internal distances and shape descriptors.

Distances between sets of points on a line are sums over all member pairs.
They come from running counts along the sorted line, since
sum |x - y| = integral of F_a (n_b - F_b) + F_b (n_a - F_a), so no pair of
points is ever made and an entity may own any share of the points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.operators.ordering import with_bucket


def _along_the_line(points: DataFrame, weights: list[Column]) -> DataFrame:
    """Per (entity, x): counts so far f0.., totals n0.. and the gap to the next x."""
    names = [f"_c{i}" for i in range(len(weights))]
    rows = points.groupBy("entity", "x").agg(*[w.alias(n) for w, n in zip(weights, names)])
    rows = with_bucket(rows, "x", "_b")
    group = Window.partitionBy("entity")
    ahead = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("entity", "_b").agg(*[F.sum(n).alias(n) for n in names], F.min("x").alias("_first"))
    offsets = totals.select(
        "entity", "_b", F.lead("_first").over(group.orderBy("_b")).alias("_next"),
        *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_o{i}") for i, n in enumerate(names)],
        *[F.sum(n).over(group).alias(f"n{i}") for i, n in enumerate(names)])
    inside = Window.partitionBy("entity", "_b").orderBy("x")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "entity", "_b", "x", F.lead("x").over(inside).alias("_lead"),
        *[F.sum(n).over(upto).alias(f"_l{i}") for i, n in enumerate(names)])
    gap = F.coalesce(F.coalesce("_lead", "_next") - F.col("x"), F.lit(0.0))
    return local.join(offsets, ["entity", "_b"]).select(
        "entity", "x", gap.alias("gap"), *[(F.col(f"_o{i}") + F.col(f"_l{i}")).alias(f"f{i}") for i in range(len(names))],
        *[f"n{i}" for i in range(len(names))])


def set_distances(points: DataFrame, sets: int) -> DataFrame:
    """(entity, i, j, distance), i < j: mean |x - y| over members of both sets.

    ``points`` is (entity, s, x) with s in 0 .. sets - 1.
    """
    line = _along_the_line(points, [F.count_if(F.col("s") == i) for i in range(sets)])
    c = F.col
    cells, entries = [], []
    for i in range(sets):
        for j in range(i + 1, sets):
            mass = c(f"f{i}") * (c(f"n{j}") - c(f"f{j}")) + c(f"f{j}") * (c(f"n{i}") - c(f"f{i}"))
            cells.append(F.sum(c("gap") * mass).alias(f"d{i}_{j}"))
            size = F.nullif((c(f"n{i}") * c(f"n{j}")).cast("double"), F.lit(0.0))
            entries.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (c(f"d{i}_{j}") / size).alias("distance")))
    per = line.groupBy("entity").agg(*cells, *[F.max(f"n{i}").alias(f"n{i}") for i in range(sets)])
    return per.select("entity", F.inline(F.array(*entries))).filter("distance IS NOT NULL")


def build_clouds(points: DataFrame, sets: int, type_of: Column) -> DataFrame:
    """(entity, sets, types, weights, dist): each occupied set is one point.

    Members are summed up in their set, so a cloud has at most ``sets`` points
    and the lists are bounded whatever the number of members. Weights are equal;
    ``dist`` is the full symmetric matrix in rows. Entities without a point of a
    known type have no cloud.
    """
    occupied = points.groupBy("entity").agg(F.array_sort(F.collect_set("s")).alias("sets"))
    d = set_distances(points, sets)
    both = d.select("entity", "i", "j", "distance").unionByName(
        d.select("entity", F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    entries = both.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "distance"))).alias("_d"))
    joined = occupied.join(entries, "entity", "left")
    cell = lambda i, j: F.when(i == j, 0.0).otherwise(
        F.try_element_at("_d", F.struct(i.alias("i"), j.alias("j"))))
    return joined.select(
        "entity", "sets",
        F.transform("sets", lambda s: type_of(s)).alias("types"),
        F.transform("sets", lambda s: 1.0 / F.size("sets")).alias("weights"),
        F.transform("sets", lambda i: F.transform("sets", lambda j: cell(i, j))).alias("dist"))


def cloud_descriptors(points: DataFrame, types: list[str]) -> DataFrame:
    """Type counts, n, and mean, std and max of the distances of all point pairs.

    ``points`` is (entity, type, x). One point alone has n and nothing else.
    """
    counts = points.groupBy("entity").agg(
        *[F.count_if(F.col("type") == v).alias(f"n_{v}") for v in types],
        F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("_var"), (F.max("x") - F.min("x")).alias("highest"))
    line = _along_the_line(points, [F.count(F.lit(1))])
    mass = line.groupBy("entity").agg(F.sum(F.col("gap") * F.col("f0") * (F.col("n0") - F.col("f0"))).alias("_sum"))
    n = F.col("n").cast("double")
    pairs = F.nullif(n * (n - 1) / 2.0, F.lit(0.0))
    mean, square = F.col("_sum") / pairs, n * n * F.col("_var") / pairs
    several = F.col("n") > 1
    zero = F.lit(0.0)
    return counts.join(mass, "entity").select(
        "entity", *[f"n_{v}" for v in types], "n",
        F.when(several, mean).otherwise(zero).alias("mean"),
        F.when(several, F.sqrt(F.greatest(square - mean * mean, zero))).otherwise(zero).alias("std"),
        F.when(several, F.col("highest")).otherwise(zero).alias("highest"))


def shape_moments(points: DataFrame) -> DataFrame:
    """(entity, subset, ref, mean, std, skew): distances to four reference points.

    The points are the centroid, the member nearest to it, the member farthest
    from it, and the member farthest from that one; ties go to the smaller id.
    Subsets are all members and each type. ``points`` is (entity, id, type, x, y).
    """
    gap = lambda px, py: F.sqrt((F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py))
    here = F.struct("x", "y")
    ctd = points.groupBy("entity").agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("ctd"))
    d = F.round(gap(F.col("ctd.x"), F.col("ctd.y")), 9)
    near = points.join(ctd, "entity").groupBy("entity").agg(
        F.first("ctd").alias("ctd"), F.min_by(here, F.struct(d, F.col("id"))).alias("cst"),
        F.max_by(here, F.struct(d, -F.col("id"))).alias("fct"))
    d = F.round(gap(F.col("fct.x"), F.col("fct.y")), 9)
    refs = points.join(near, "entity").groupBy("entity").agg(
        *[F.first(c).alias(c) for c in ("ctd", "cst", "fct")],
        F.max_by(here, F.struct(d, -F.col("id"))).alias("ftf"))
    long = points.join(refs, "entity").select(
        "entity", F.explode(F.array(F.lit("all"), F.col("type"))).alias("subset"),
        *[gap(F.col(f"{r}.x"), F.col(f"{r}.y")).alias(r) for r in ("ctd", "cst", "fct", "ftf")])
    flat = long.unpivot(["entity", "subset"], ["ctd", "cst", "fct", "ftf"], "ref", "d")
    spread = F.stddev_pop("d")
    return flat.groupBy("entity", "subset", "ref").agg(
        F.avg("d").alias("mean"), spread.alias("std"),
        F.when(spread > 1e-9, F.skewness("d")).otherwise(F.lit(0.0)).alias("skew"))
