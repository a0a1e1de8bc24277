"""Neighbours of every record, and joins of sets by overlap, without comparing all records.

Features are ordered by how many records have them, rare ones first. Two sets
that overlap enough share some among the first of both, so records meet on those
alone, several times, and only where sizes and the places of the shared features
leave room for the overlap. Frequent features are met by size band: one
feature of a third of all records is many join keys, and none is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.operators.postings import containment_blocks
from likeness.session import cut_lineage

#: Ratio of the sizes at a size band's ends.
BAND = 2.0
#: Rare features by which first neighbours are sought, and places looked at beside each.
SEED_FEATURES, SEED_PLACES = 2, 3
#: Meetings among the rare features that make a candidate, at most. Each takes one more place of both
#: sets, so there are no more than half the places that a single meeting needs.
MEETINGS, MEETING_SHARE = 16, 2
_SLACK = 1e-9  # products of a bound and a size that should be whole


@dataclass(frozen=True)
class Overlap:
    """What a bound t on a similarity asks of two sets of sizes n and m."""

    least: Callable  # (n, t): size of the other set
    greatest: Callable
    shared: Callable  # (n, m, t): features in both
    value: Callable  # (shared, n, m): the similarity
    asker: Callable  # (n, t): size of the largest set that asks for one of n
    met: Callable  # (n, t): least overlap of a set of n with one that asks for it
    smaller_asks: bool = True  # each pair is asked for once, by the smaller set, and all bounds are one


def _up(x: Column) -> Column:
    return F.ceil(x - F.lit(_SLACK))


#: Shared over joint features.
TANIMOTO = Overlap(
    lambda n, t: _up(n * t), lambda n, t: F.floor(n / t + F.lit(_SLACK)),
    lambda n, m, t: _up(t / (F.lit(1.0) + t) * (n + m)),
    lambda shared, n, m: shared / (n + m - shared),
    lambda n, t: F.floor(n / t + F.lit(_SLACK)), lambda n, t: _up(n * t), smaller_asks=False)
#: The same where all bounds are one: a set shares more with a larger one, so fewer of its places are asked for.
TANIMOTO_OF_LARGER = replace(TANIMOTO, least=lambda n, t: n, asker=lambda n, t: n, smaller_asks=True)
#: Shared features over the smaller set.
CONTAINMENT = Overlap(
    lambda n, t: n, lambda n, t: F.lit(2**31 - 1).cast("long"), lambda n, m, t: _up(F.least(n, m) * t),
    lambda shared, n, m: shared / F.least(n, m), lambda n, t: n, lambda n, t: F.lit(1).cast("long"))


def _band(n: Column) -> Column:
    return F.floor(F.ln(n.cast("double")) / F.lit(math.log(BAND))).cast("int")


def ranked_sets(sets: DataFrame) -> DataFrame:
    """(id, n, common): ``common`` are the features of two or more sets, rarest first; the others only count in ``n``.

    ``sets`` is (id, feats) with distinct features. Sets that share nothing are left out.
    """
    # The outer form: of the plain one Spark makes a filter on features, which computes them once more beside the scan.
    each = sets.select("id", F.size("feats").alias("n"), F.explode_outer("feats").alias("f")).filter("f IS NOT NULL")
    counted = each.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("f")).cast("int")).filter("df > 1")
    # Two lists of plain numbers in one order: what is shuffled back is 12 bytes a feature, a struct of both is 32.
    common = counted.groupBy("id", "n").agg(F.collect_list("df").alias("df"), F.collect_list("f").alias("f"))
    rarest = F.sort_array(F.arrays_zip("df", "f"))
    return cut_lineage(common.select("id", F.col("n").cast("long").alias("n"), F.transform(rarest, lambda c: c["f"]).alias("common")), "ranked")


def _prefix(ranked: DataFrame, length: Column, *extra: str) -> DataFrame:
    """(id, n, f, place, extra) of the first ``length`` features of each set, those of one set alone counted."""
    alone = F.col("n") - F.size("common")
    kept = F.slice("common", 1, F.greatest(length - alone, F.lit(0)).cast("int"))
    return ranked.select("id", "n", *extra, alone.alias("_alone"), F.posexplode(kept).alias("_at", "f")).select(
        "id", "n", *extra, "f", (F.col("_alone") + F.col("_at") + 1).cast("int").alias("place"))


def _spare(n: Column, t: Column, kind: Overlap) -> Column:
    """Features of an asking set that the other need not have."""
    return n - kind.shared(n, kind.least(n, t), t)


def _meetings(spare: Column) -> Column:
    return F.least(F.floor(spare / F.lit(MEETING_SHARE)) + 1, F.lit(MEETINGS)).cast("long")


def candidates(
    ranked: DataFrame, bounds: DataFrame | float, floor: float, kind: Overlap = TANIMOTO, groups: DataFrame | None = None
) -> DataFrame:
    """Distinct (a, b), a < b, that can reach the bound of one of them; ``bounds`` is (id, t), t >= floor, or one number.

    Sets that share o features have the first m of these (m <= o) among their
    first n - o + m features, in both sets. So a pair must meet m times there, up
    to ``MEETINGS``: one frequent feature in common is no candidate. Short sets
    meet once, on their rarest features alone. With ``groups`` (id, group) pairs
    of one group are left out as they meet.
    """
    t, n, na, nb = (F.col(c) for c in ("t", "n", "na", "nb"))
    if isinstance(bounds, float):  # one for all
        own, t, extra = ranked, F.lit(bounds), ()
    else:
        own, extra = ranked.join(bounds, "id"), ("t",)
    wanted = lambda n: F.least(n - _spare(n, t, kind), _meetings(_spare(n, t, kind)))
    asking = _prefix(own, _spare(n, t, kind) + wanted(n), *extra)
    low, high = kind.least(n, t), F.least(kind.greatest(n, t), F.lit(2**31 - 1).cast("long"))
    high = F.greatest(low, F.least(high, ranked.agg(F.max("n")).scalar()))  # the largest set is known from the data
    asking = asking.select(F.col("id").alias("a"), n.cast("int").alias("na"), F.col("place").alias("pa"), *extra, "f",
                           F.explode(F.sequence(_band(low), _band(high))).alias("band"))
    # As many places more as the largest set that may ask wants meetings.
    t0 = F.lit(float(floor))
    whole = n - kind.met(n, t0) + _meetings(_spare(kind.asker(n, t0), t0, kind))
    asked = _prefix(ranked, whole).select(
        F.col("id").alias("b"), n.cast("int").alias("nb"), F.col("place").alias("pb"), "f", _band(n).alias("band"))
    if groups is not None:
        asking = asking.join(groups.select(F.col("id").alias("a"), F.col("group").alias("ga")), "a")
        asked = asked.join(groups.select(F.col("id").alias("b"), F.col("group").alias("gb")), "b")
    room = F.least(na - F.col("pa"), nb - F.col("pb")) + wanted(na) >= kind.shared(na, nb, t)
    sizes = (nb >= kind.least(na, t)) & (nb <= kind.greatest(na, t))
    other = (nb > na) | (F.col("a") < F.col("b")) if kind.smaller_asks else F.col("a") != F.col("b")
    met = asking.join(asked, ["f", "band"]).filter(other & sizes & room)
    if groups is not None:
        met = met.filter("ga <> gb")
    # All that two sets share up to their last meeting has met; the rest lies behind it in both.
    met = met.select("a", "b", wanted(na).cast("int").alias("times"), kind.shared(na, nb, t).cast("int").alias("least"),
                     F.least(na - F.col("pa"), nb - F.col("pb")).cast("int").alias("behind"))
    often = met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("met"), F.first("times").alias("times"), F.first("least").alias("least"),
        F.min("behind").alias("behind")).filter("met >= times AND met + behind >= least")
    pairs = often.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs if kind.smaller_asks else pairs.distinct()


def measured(pairs: DataFrame, ranked: DataFrame, kind: Overlap = TANIMOTO, out: str = "sim") -> DataFrame:
    """(a, b, out): exact overlap of listed pairs. Pairs are written, so a short list travels to the sets."""
    pairs = cut_lineage(pairs, "measured")
    own = lambda side: ranked.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("common").alias(f"f{side}"))
    shared = F.size(F.array_intersect("fa", "fb"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select(
        "a", "b", kind.value(shared, F.col("na"), F.col("nb")).alias(out))


def overlap_join(sets: DataFrame, threshold: float, kind: Overlap = TANIMOTO, out: str = "sim") -> DataFrame:
    """(a, b, out), a < b: all pairs of sets at or above ``threshold``, exact.

    A set of any size may hold a small one, so sizes say little about containment
    and most pairs would meet: those sets are counted by blocks.
    """
    if kind is CONTAINMENT:
        return containment_blocks(sets, threshold, out)
    return ranked_join(ranked_sets(sets), threshold, kind, out)


def ranked_join(
    ranked: DataFrame, threshold: float, kind: Overlap = TANIMOTO, out: str = "sim", groups: DataFrame | None = None
) -> DataFrame:
    """The same of ``ranked_sets``; with ``groups`` (id, group), pairs of different groups only."""
    kind = TANIMOTO_OF_LARGER if kind is TANIMOTO else kind
    return measured(candidates(ranked, float(threshold), threshold, kind, groups), ranked, kind, out).filter(F.col(out) >= threshold)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def first_pairs(ranked: DataFrame) -> DataFrame:
    """(a, b, sim), a < b: some pairs that may be near, a number in proportion to the records.

    Sets that share one of their rarest features stand in order of size, and each
    is compared with the next few.
    """
    key = _prefix(ranked, F.col("n") - F.size("common") + SEED_FEATURES).withColumn("band", _band(F.col("n")))
    order = Window.partitionBy("f", "band").orderBy("n", "id")
    ahead = key.select(F.col("id").alias("a"), F.array(*[F.lead("id", i).over(order) for i in range(1, SEED_PLACES + 1)]).alias("next"))
    ahead = ahead.select("a", F.explode("next").alias("b")).filter("b IS NOT NULL")
    pairs = ahead.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return measured(pairs, ranked)


def first_bounds(ranked: DataFrame, k: int, floor: float, max_similarity: float = 1.0) -> DataFrame:
    """(id, t): a similarity that k other sets are known to reach, at least ``floor``."""
    known = _both_ways(first_pairs(ranked).filter(F.col("sim") <= max_similarity))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    reached = known.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k).select(
        F.col("a").alias("id"), F.col("sim").alias("reached"))
    return ranked.select("id").join(reached, "id", "left").select(
        "id", F.greatest(F.coalesce("reached", F.lit(0.0)), F.lit(float(floor))).alias("t"))


def near_records(sets: DataFrame, k: int, floor: float, max_similarity: float = 1.0) -> DataFrame:
    """(a, b, sim, rank): for every record the k nearest others by Tanimoto, at or above ``floor``, exact.

    Pairs above ``max_similarity`` are passed over.
    ``sets`` is (id, feats). Records of equal sets are no neighbours of one
    another; any number of them is one set while neighbours are sought, of which
    the k smallest ids stand for the rest. Ties go to the smaller id. A record
    without features has no neighbour.
    """
    content = F.md5(F.array_join(F.array_sort("feats"), ","))
    hashed = sets.select("id", content.alias("content"))
    first = Window.partitionBy("content").orderBy("id")
    leading = hashed.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    groups = cut_lineage(leading.groupBy("content").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        "content", F.element_at("ids", 1).alias("id"), "ids"), "contents")
    ranked = ranked_sets(sets.join(groups.select("id"), "id", "left_semi"))
    bounds = cut_lineage(first_bounds(ranked, k, floor, max_similarity), "bounds")
    found = measured(candidates(ranked, bounds, floor), ranked).filter((F.col("sim") >= floor) & (F.col("sim") <= max_similarity))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    nearest = _both_ways(found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
    copies = nearest.join(groups.select(F.col("id").alias("b"), "ids"), "b").select("a", F.explode("ids").alias("b"), "sim")
    chosen = copies.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    members = hashed.join(groups.select("content", F.col("id").alias("leader")), "content").select("id", "leader")
    return members.join(chosen, F.col("leader") == F.col("a")).select(F.col("id").alias("a"), "b", "sim", "rank")
