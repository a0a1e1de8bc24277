"""Grouped scores of a long prediction table.

Rank metrics work on counted values (see ``ordering``), so one task, method or
regime may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.draws import digest
from likeness.functions.scalars import finite
from likeness.operators.ordering import dense_index, running_total, top_fraction, value_ranks, with_bucket
from likeness.session import cut_lineage


def _centred(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    ranks = value_ranks(df, keys, value)
    return ranks.select(*keys, value, (F.col("avg_rank") - (F.col("total") + 1) / 2.0).alias(out))


def present(df: DataFrame, *values: str) -> DataFrame:
    """Rows in which all values are there and finite: NULL, NaN and infinities have no rank."""
    for value in values:
        df = df.filter(F.abs(F.col(value).cast("double")) < float("inf"))  # NaN is above infinity
    return df


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """Rank correlation with averaged ties over rows with both values; NULL when either side is constant."""
    keys, df = list(keys), present(df, x, y)
    cells = df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cells.join(_centred(df, keys, x, "_rx"), [*keys, x]).join(_centred(df, keys, y, "_ry"), [*keys, y])
    moment = lambda a, b: F.sum(F.col("_n") * F.col(a) * F.col(b))
    spread = F.sqrt(moment("_rx", "_rx")) * F.sqrt(moment("_ry", "_ry"))
    return ranked.groupBy(*keys).agg((moment("_rx", "_ry") / F.nullif(spread, F.lit(0.0))).alias(out))


def linear_correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; NULL (not an error) for a constant column."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, label: str, out: str = "auc") -> DataFrame:
    """AUC from averaged ranks; NULL when a class is missing. ``label`` is boolean.

    Rows without a finite score or without a label don't count.
    """
    ranks = value_ranks(present(df, score).filter(F.col(label).isNotNull()), keys, score, [F.count_if(F.col(label)).cast("double").alias("_pos")])
    pos = F.sum("_pos")
    neg = F.sum("n") - pos
    won = F.sum(F.col("_pos") * F.col("avg_rank")) - pos * (pos + 1) / 2.0
    return ranks.groupBy(*keys).agg((won / F.nullif(pos * neg, F.lit(0.0))).alias(out))


def errors(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    gap = F.col(y) - F.col(pred)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.count(F.lit(1)).alias("n"))


def relative_error(df: DataFrame, keys: Sequence[str], y: str, pred: str, out: str = "rae") -> DataFrame:
    """Mean absolute error over mean absolute deviation from the mean."""
    means = df.groupBy(*keys).agg(F.avg(y).alias("_mean"))
    return df.join(means, list(keys)).groupBy(*keys).agg(
        (F.avg(F.abs(F.col(y) - F.col(pred)))
         / F.nullif(F.avg(F.abs(F.col(y) - F.col("_mean"))), F.lit(0.0))).alias(out))


def top_precision_recall(
    df: DataFrame, keys: Sequence[str], score: str, key: str, active: str, frac: float = 0.1
) -> DataFrame:
    """Precision and recall of the best ``frac`` by score; ``active`` is boolean."""
    flagged = top_fraction(df, keys, score, key, frac)
    hit = F.count_if(F.col("in_top") & F.col(active)).cast("double")
    return flagged.groupBy(*keys).agg(
        (hit / F.count_if("in_top")).alias("prec10"),
        (hit / F.nullif(F.count_if(active).cast("double"), F.lit(0.0))).alias("rec10"))


def ordinal_rank01(df: DataFrame, keys: Sequence[str], value: str, key: str, out: str) -> DataFrame:
    """Ordinal rank scaled to [0, 1]; equal values are told apart by key hash.

    One order by (value, hash): rows are read for its edges, its totals and its
    places, so ``df`` should be a written table.
    """
    parts = [key] if isinstance(key, str) else list(key)
    hashed = with_bucket(df.withColumn("_hash", digest(*parts, seed="rank01")), value, tie=F.col("_hash"))
    placed = running_total(hashed, keys, F.col("_value_bucket"), [value, "_hash", *parts], F.lit(1), before="_before", total="_total")
    rank = F.col("_before") / F.nullif((F.col("_total") - 1).cast("double"), F.lit(0.0))
    return placed.withColumn(out, rank).drop("_hash", "_value_bucket", "_before", "_total")


def task_metrics(predictions: DataFrame, keys: Sequence[str], key: str, y: str, pred: str, frac: float = 0.1) -> DataFrame:
    """Seven metrics per keys; all NULL below 5 rows or for a constant prediction.

    Both rankings are made once and joined to the rows; every metric is then an
    aggregate of the same pass. Active rows are those at or above the third
    quartile of y. Only rows whose prediction ties with the edge of the best
    ``frac`` are put in an order of their own, by key hash.
    """
    keys = list(keys)
    ok = predictions.withColumn(y, finite(y)).withColumn(pred, finite(pred)).dropna(subset=[y, pred])
    ranks_y = cut_lineage(value_ranks(ok, keys, y).select(
        *keys, y, F.col("n").alias("_ny"), F.col("before").alias("_by"), F.col("avg_rank").alias("_ry"), F.col("total").alias("n")), "ranks")
    ranks_p = cut_lineage(value_ranks(ok, keys, pred).select(
        *keys, pred, F.col("n").alias("_np"), F.col("before").alias("_bp"), F.col("avg_rank").alias("_rp")), "ranks")
    at = (F.col("n") - 1) * F.lit(0.75)
    covers = lambda p: (F.col("_by") <= p) & (p < F.col("_by") + F.col("_ny"))
    low, high = F.floor(at), F.ceil(at)
    quartile = ranks_y.filter(covers(low) | covers(high)).groupBy(*keys).agg(
        F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.max(at - low).alias("_part"))
    active_y = ranks_y.join(quartile, keys).withColumn(
        "_active", F.col(y) >= F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).drop("_lo", "_hi", "_part", "_ny", "_by")
    k = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(frac)).cast("long"))
    above = F.col("n") - F.col("_bp") - F.col("_np")  # rows with a better prediction
    rows = ok.select(*keys, key, y, pred).join(active_y, [*keys, y]).join(ranks_p, [*keys, pred]).withColumn(
        "_room", k - above).withColumn("_side", F.when(F.col("_room") >= F.col("_np"), 1).when(F.col("_room") > 0, 0).otherwise(-1))
    rows = cut_lineage(rows.drop("_bp", "_by"), "ranked")
    tied = dense_index(rows.filter("_side = 0").select(*keys, key, "_active", "_room"), key, "top", keys, index="_pos")
    drawn = tied.filter("_pos < _room").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_drawn"), F.count_if(F.col("_active")).alias("_drawn_hits"))
    gap = F.col(y) - F.col(pred)
    middle = (F.col("n") + 1) / 2.0
    ry, rp = F.col("_ry") - middle, F.col("_rp") - middle
    spread = F.sqrt(F.sum(ry * ry)) * F.sqrt(F.sum(rp * rp))
    pos = F.count_if(F.col("_active")).cast("double")
    neg = F.count_if(~F.col("_active")).cast("double")
    won = F.sum(F.when(F.col("_active"), F.col("_rp"))) - pos * (pos + 1) / 2.0
    scored = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(pred).alias("_least"), F.max(pred).alias("_most"),
        (F.sum(ry * rp) / F.nullif(spread, F.lit(0.0))).alias("spearman"), linear_correlation(y, pred).alias("pearson"),
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (won / F.nullif(pos * neg, F.lit(0.0))).alias("roc_auc"), pos.alias("_actives"),
        F.count_if(F.col("_side") == 1).alias("_top"), F.count_if(F.col("_active") & (F.col("_side") == 1)).alias("_hits"))
    usable = (F.col("n") >= 5) & (F.col("_least") < F.col("_most"))
    both = usable & F.col("roc_auc").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    hits = (F.col("_hits") + zero("_drawn_hits")).cast("double")
    top = {"prec10": hits / (F.col("_top") + zero("_drawn")), "rec10": hits / F.nullif(F.col("_actives"), F.lit(0.0))}
    return scored.join(drawn, keys, "left").select(
        *keys, "n",
        *[F.when(usable, F.col(c)).alias(c) for c in ("spearman", "pearson", "mae", "rmse", "roc_auc")],
        *[F.when(both, c).alias(name) for name, c in top.items()])


# Limits of the two regimes, relatedness in standard deviations,
# and the smallest regime that is scored.
HOP_MAX, CLIFF_MIN, RELATED_Z, MIN_REGIME = 0.35, 0.60, 3.0, 100


def with_regimes(pairs: DataFrame, structural: str) -> DataFrame:
    """Each pair once as ``overall`` and once more in its regime, if any."""
    s = F.col(structural)
    own = F.when(s < HOP_MAX, "scaffold_hop").when(s > CLIFF_MIN, "cliff")
    return pairs.withColumn("regime", F.explode(F.array_compact(F.array(F.lit("overall"), own))))


def regime_metrics(
    scored: DataFrame, method: str, score: str, truth: str, structural: str, related_z: float = RELATED_Z
) -> DataFrame:
    """(method, regime, n, spearman, auc) against the truth and its class z >= ``related_z``."""
    rows = with_regimes(scored, structural).withColumn("_related", F.col(truth) >= related_z)
    keys = [method, "regime"]
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = n.join(spearman(rows, keys, score, truth), keys, "left").join(
        roc_auc(rows, keys, score, "_related"), keys, "left")
    enough = F.col("n") >= MIN_REGIME
    return joined.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("spearman", "auc")])
