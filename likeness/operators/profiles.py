"""Sparse profile algebra on COO tables (entity, target, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.operators.sampling import random_pairs
from likeness.session import cut_lineage
from likeness.sources.tables import dealt, tasks_for

# Edges of the profile-size bins and the smallest usable bin.
SIZE_EDGES = (1, 2, 3, 5, 8, 13, 21, 34, 10**6)
MIN_BACKGROUND = 50
# A sum that cancels leaves less than this, depending on the order of addition.
RESIDUE = 1e-12
#: Targets of the widest profile in one segment.
SEGMENT = 256


def raw_profiles(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls as a sparse matrix; targets that are not listed are dropped."""
    return calls.join(targets.select("target").distinct(), "target", "left_semi").select(
        "entity", "target", "value"
    )


def target_idf(raw: DataFrame) -> DataFrame:
    """(target, hits, idf). A call graded exactly 0 is no hit."""
    n = raw.agg(F.count_distinct("entity").cast("double")).scalar()
    hits = raw.groupBy("target").agg(F.count_if(F.col("value") != 0).alias("hits"))
    return hits.withColumn("idf", F.ln(n / F.greatest(F.col("hits"), F.lit(1))))


def idf_weight(raw: DataFrame, idf: DataFrame) -> DataFrame:
    return raw.join(idf.select("target", "idf"), "target").select(
        "entity", "target", (F.col("value") * F.col("idf")).alias("value")
    )


def smooth(weighted: DataFrame, relatedness: DataFrame) -> DataFrame:
    """weighted x relatedness(t1, t2, value); exact zeros are not stored.

    Rows are dealt by entity before they are multiplied, so what is shuffled is
    the profile and not its products. Whether the relatedness table is shipped
    whole or shuffled is left to its measured size.
    """
    rel = relatedness.select(F.col("t1").alias("target"), "t2", F.col("value").alias("_rel"))
    return (
        weighted.repartition("entity").join(rel, "target")
        .groupBy("entity", F.col("t2").alias("target"))
        .agg(F.sum(F.col("value") * F.col("_rel")).alias("value"))
        .filter(F.abs("value") > RESIDUE)
    )


def row_norms(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("entity").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def density(coo: DataFrame, row: str, col: str) -> DataFrame:
    cells = F.count(F.lit(1))
    size = F.count_distinct(row) * F.count_distinct(col)
    return coo.agg(cells.alias("nnz"), size.alias("size"), (cells / size).alias("density"))


def unit_rows(profiles: DataFrame) -> tuple[DataFrame, int]:
    """(entity, segment, units, size) and the number of segments: profiles of length one as maps by target, written once.

    A profile travels with its pairs as one row and not as a row for each target.
    The widest one sets the number of segments, which have about SEGMENT targets of
    it each, so no row grows with the targets. Every entity has segment 0.
    """
    whole = Window.partitionBy("entity")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(whole))
    unit = dealt(profiles.select("entity", "target", "value"), tasks_for(profiles), "entity").select(
        "entity", "target", (F.col("value") / F.nullif(norm, F.lit(0.0))).alias("_u"), F.count(F.lit(1)).over(whole).alias("size"))
    widest = profiles.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    segments = max(1, -(-widest // SEGMENT))
    if segments > 1:
        own = F.pmod(F.xxhash64("target"), F.lit(segments)).cast("int")
        entry = lambda at, *cols: F.struct(at.alias("segment"), *cols)
        kept, none = entry(own, F.col("target"), F.col("_u")), entry(
            F.lit(0), F.lit(None).cast(dict(unit.dtypes)["target"]).alias("target"), F.lit(None).cast("double").alias("_u"))
        unit = unit.select("entity", "size", F.explode(F.when(own == 0, F.array(kept)).otherwise(F.array(kept, none))).alias("e")).select(
            "entity", "size", "e.segment", "e.target", "e._u")
    else:
        unit = unit.withColumn("segment", F.lit(0))
    entries = F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "_u"))))
    rows = unit.groupBy("entity", "segment").agg(F.map_from_entries(entries).alias("units"), F.max("size").alias("size"))
    return cut_lineage(rows.select("entity", "segment", "units", "size"), "units"), segments


def with_cosine(pairs: DataFrame, units: tuple[DataFrame, int]) -> DataFrame:
    """Add raw, size_a and size_b to distinct rows of pairs (a, b, ...); no profile has size NULL and cosine 0.

    The left joins keep pairs that share nothing. Only several segments have to be
    summed again. Two maps meet by a hash of their targets, in time proportional to
    their sizes; a search for each target of one in the other is quadratic.
    """
    rows, segments = units
    side = lambda s: rows.select(
        F.col("entity").alias(s), F.col("segment").alias(f"_s{s}"), F.col("units").alias(f"_u{s}"), F.col("size").alias(f"size_{s}"))
    met = pairs.join(side("a"), "a", "left").withColumn("_sa", F.coalesce("_sa", F.lit(0)))
    left, right = met.alias("l"), side("b").alias("r")
    same = F.col("l.b") == F.col("r.b")
    met = left.join(right, same if segments == 1 else same & (F.col("l._sa") == F.col("r._sb")), "left").drop(F.col("r.b"))
    shared = F.map_values(F.map_zip_with("_ua", "_ub", lambda _t, u, v: u * v))
    part = F.coalesce(F.aggregate(shared, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0))), F.lit(0.0))
    if segments == 1:
        return met.select(*pairs.columns, part.alias("raw"), "size_a", "size_b")
    return met.groupBy(*pairs.columns).agg(F.sum(part).alias("raw"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))


def cosine_of_pairs(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(a, b, raw): sparse cosine of the distinct listed pairs, 0 without overlap.

    Pairs are few bytes and much work, so their partitions are fixed and not merged by size afterwards.
    """
    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    distinct = pairs.select("a", "b").repartition(tasks, "a", "b").distinct()
    return with_cosine(distinct, unit_rows(profiles)).select("a", "b", "raw")


def size_bin(size: Column) -> Column:
    """Number of edges at or below ``size``."""
    bin_ = F.lit(0)
    for i, edge in enumerate(SIZE_EDGES, 1):
        bin_ = F.when(size >= edge, i).otherwise(bin_)
    return bin_


def with_bins(scored: DataFrame) -> DataFrame:
    """bin_a and bin_b for size_a and size_b; an entity without a profile is in bin 0."""
    own = lambda s: F.coalesce(size_bin(F.col(f"size_{s}")), F.lit(0)).alias(f"bin_{s}")
    return scored.select(*[c for c in scored.columns if c not in ("size_a", "size_b")], own("a"), own("b"))


def background_stats(sample: DataFrame) -> DataFrame:
    """Mean and spread of raw similarity per ordered bin pair, where n >= 50."""
    spread = F.stddev_pop("raw")
    return (
        sample.groupBy("bin_a", "bin_b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("raw").alias("mean"),
            F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("std"),
        )
        .filter(F.col("n") >= MIN_BACKGROUND)
    )


def background_sample(entities: DataFrame, units: tuple[DataFrame, int], per_entity: int, seed: str) -> DataFrame:
    """Random pairs with raw similarity and both bins; a pair drawn twice counts twice."""
    scored = with_bins(with_cosine(random_pairs(entities, "entity", per_entity, seed), units))
    return cut_lineage(scored.select("draw", "a", "b", "raw", "bin_a", "bin_b"), "background")


def size_matched_z(scored: DataFrame, sample: DataFrame) -> DataFrame:
    """Add ``z``: raw of scored pairs (with_cosine) against random pairs of the same two size bins."""
    # At most len(SIZE_EDGES + 1)**2 = 100 rows, so shipping it whole is safe.
    stats = F.broadcast(background_stats(sample).select("bin_a", "bin_b", "mean", "std"))
    spread = F.stddev_pop("raw")
    overall = sample.agg(
        F.struct(
            F.avg("raw").alias("mean"),
            F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("std"),
        )
    ).scalar()
    binned = with_bins(scored).join(stats, ["bin_a", "bin_b"], "left")
    mean = F.coalesce("mean", overall["mean"])
    std = F.coalesce("std", overall["std"])
    return binned.withColumn("z", (F.col("raw") - mean) / std).drop("bin_a", "bin_b", "mean", "std")
