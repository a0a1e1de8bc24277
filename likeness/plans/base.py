"""The given tables seen as measurements, calls and texts.

Entities are parts, targets are suppliers (many) or nations (a fixed, small
dimension), potency is ``4 + quantity / 20``, rows with tax of 0.07 and more are
censored, and a discount of 0.10 and more marks a record as invalid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.scalars import bound_from_value, conditions_hash
from likeness.operators.calls import activity_calls
from likeness.operators.curate import Rules
from likeness.operators.lineage import lineage_similarity, max_merge
from likeness.operators.profiles import idf_weight, raw_profiles, smooth, target_idf
from likeness.plans.registry import Tables
from likeness.session import cut_lineage
from likeness.sources.tables import dealt, spread, tasks_for

#: Least similarity of structural neighbours: below it a pair counts as a scaffold hop, not as close.
CLOSE = 0.35
RULES = Rules(types=("A", "N", "R"), assay_types=("F", "O", "P"))
#: For the derived quality fields of ``measurements(strict=True)``: every predicate rejects rows.
STRICT_RULES = Rules(types=("A", "R"), assay_types=("F", "O"))


def measurements(t: Tables, strict: bool = False) -> DataFrame:
    """``strict`` derives the quality fields too, so that each predicate bites."""
    lines = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    tasks = tasks_for(lines)
    orders = dealt(t.orders, tasks, "o_orderkey") if tasks else t.orders
    joined = (
        (dealt(lines, tasks, "l_orderkey") if tasks else spread(lines)).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    line = F.col("l_linenumber")
    flag = F.when(line == 7, 0).otherwise(1) if strict else F.lit(1)
    confidence = F.when(line == 6, 8).otherwise(9) if strict else F.lit(9)
    duplicate = F.when((line == 5) & (F.col("o_orderstatus") == "O"), 1).otherwise(0)
    comment = (
        F.when(F.col("o_orderpriority") == "5-LOW", "Inconclusive")
        .when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "Active")
    )
    relation = F.when(F.col("l_tax") >= 0.08, ">=").when(F.col("l_tax") >= 0.07, ">").otherwise("=")
    units = F.when(F.col("o_orderpriority") == "3-MEDIUM", "ug.mL-1").otherwise("nM")
    kind = F.when(F.col("s_nationkey") % 5 == 4, "CELL-LINE").otherwise("SINGLE PROTEIN")
    return joined.select(
        F.col("l_partkey").alias("entity"),
        F.col("l_suppkey").alias("supplier"),
        F.col("s_nationkey").cast("long").alias("nation"),
        F.col("l_returnflag").alias("type"),
        relation.alias("relation"),
        (F.lit(4.0) + F.col("l_quantity") / 20.0).alias("potency"),
        F.col("l_extendedprice").alias("value"),
        (units if strict else F.lit("nM")).alias("units"),
        flag.alias("flag"),
        F.when(F.col("l_discount") >= 0.10, "outside range").alias("validity"),
        (duplicate if strict else F.lit(0)).alias("duplicate"),
        (comment if strict else F.lit(None).cast("string")).alias("comment"),
        confidence.alias("confidence"),
        F.col("o_orderstatus").alias("assay_type"),
        (kind if strict else F.lit("SINGLE PROTEIN")).alias("target_type"),
        conditions_hash("o_orderpriority", "l_linestatus", "o_orderstatus").alias("ach"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_orderkey").alias("assay_id"),
    )


def branches(t: Tables, target: str, ach: str = "ach") -> tuple[DataFrame, DataFrame]:
    """The exact and the censored records; lines are joined once, and both branches read what was written."""
    m = measurements(t).withColumns({"_exact": RULES.exact(), "_censored": RULES.censored()})
    kept = cut_lineage(m.filter("_exact OR _censored").select(
        "entity", F.col(target).alias("target"), "type", F.col(ach).alias("ach"), "potency",
        bound_from_value("value").alias("bound"), "_exact", "_censored"), "branches")
    return kept.filter("_exact").drop("bound", "_exact", "_censored"), kept.filter("_censored").drop("potency", "_exact", "_censored")


def sparse_calls(t: Tables) -> DataFrame:
    """part x supplier."""
    return activity_calls(*branches(t, "supplier"))


def nation_calls(t: Tables) -> DataFrame:
    """part x nation: 25 targets whatever the scale."""
    return activity_calls(*branches(t, "nation", "line_status"))


# --- the same, as SQL ---------------------------------------------------------

MEAS = """meas AS (
 SELECT l_partkey AS entity, l_suppkey AS supplier, s_nationkey::BIGINT AS nation,
  l_returnflag AS type, 4.0::DOUBLE + l_quantity/20.0::DOUBLE AS potency,
  l_tax, l_discount, l_extendedprice AS value, l_linenumber, l_linestatus,
  o_orderpriority, o_orderstatus, l_orderkey AS assay_id,
  substr(md5(concat_ws('|', coalesce(o_orderpriority,''), coalesce(l_linestatus,''),
   coalesce(o_orderstatus,''))),1,16) AS ach
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey
 WHERE l_discount < 0.10)"""


def calls_sql(target: str, ach: str = "ach") -> str:
    """CTEs ending in ``calls(entity, target, value, source)``."""
    return MEAS + f""",
exact AS (SELECT entity, {target} AS target, type, {ach} AS ach, potency FROM meas
 WHERE l_tax < 0.07),
cens AS (SELECT entity, {target} AS target, 9.0::DOUBLE - log10(value) AS bound FROM meas
 WHERE l_tax >= 0.07 AND value > 0),
stats AS (SELECT entity, target, type, ach, median(potency) AS median, min(potency) AS low,
 max(potency) AS high, count(*) AS size FROM exact GROUP BY ALL),
kept AS (SELECT * FROM stats WHERE high - low <= 1.0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, target
 ORDER BY size DESC, type DESC, ach DESC) AS rn FROM kept) WHERE rn = 1),
graded AS (SELECT entity, target,
 2.0::DOUBLE * least(greatest((median - 4.5)/1.5, 0.0::DOUBLE), 1.0::DOUBLE) - 1.0::DOUBLE AS value,
 'exact' AS source FROM best),
bounds AS (SELECT entity, target, max(bound) AS bound FROM cens GROUP BY ALL HAVING max(bound) <= 4.5),
calls AS (SELECT * FROM graded UNION ALL
 SELECT entity, target, -1.0::DOUBLE, 'censored' FROM bounds b
 WHERE NOT EXISTS (SELECT 1 FROM graded g WHERE g.entity=b.entity AND g.target=b.target))"""


SPARSE_CALLS = calls_sql("supplier")
NATION_CALLS = calls_sql("nation", "l_linestatus")


def nation_targets(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("target"))


def nation_lineages(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("target"), F.array("r_name", "n_name").alias("path"))


def nation_relatedness(t: Tables) -> DataFrame:
    """Nations of one region are related by 1/2, each nation to itself by 1."""
    return max_merge([lineage_similarity(nation_lineages(t), 1, 2)], nation_targets(t))


def nation_profiles(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(raw, smoothed) profiles of parts over nations."""
    # Both are read many times over, so each is computed once and written.
    raw = cut_lineage(raw_profiles(nation_calls(t), nation_targets(t)), "raw")
    smoothed = smooth(idf_weight(raw, target_idf(raw)), nation_relatedness(t))
    return raw, cut_lineage(smoothed, "smoothed")


def supplier_profiles(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(raw, weighted) profiles of parts over suppliers: many targets, each related to itself alone."""
    raw = cut_lineage(sparse_calls(t).select("entity", "target", "value"), "raw")
    return raw, cut_lineage(idf_weight(raw, target_idf(raw)).filter("value <> 0"), "weighted")


SUPPLIER_PROFILES = SPARSE_CALLS + """,
raw AS MATERIALIZED (SELECT entity, target, value FROM calls),
idf AS (SELECT target, count(*) FILTER (value <> 0) AS hits,
 ln((SELECT count(DISTINCT entity) FROM raw)::DOUBLE / greatest(count(*) FILTER (value <> 0), 1)) AS idf FROM raw GROUP BY target),
smoothed AS MATERIALIZED (SELECT * FROM (SELECT entity, target, value*idf AS value FROM raw JOIN idf USING (target)) WHERE value <> 0)"""
PROFILES = NATION_CALLS + """,
raw AS (SELECT entity, target, value FROM calls WHERE target IN (SELECT n_nationkey FROM nation)),
rel AS (SELECT a.n_nationkey::BIGINT AS t1, b.n_nationkey::BIGINT AS t2,
 CASE WHEN a.n_nationkey=b.n_nationkey THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS value
 FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey),
idf AS (SELECT target, count(*) FILTER (value <> 0) AS hits,
 ln((SELECT count(DISTINCT entity) FROM raw)::DOUBLE / greatest(count(*) FILTER (value <> 0), 1)) AS idf
 FROM raw GROUP BY target),
weighted AS (SELECT entity, target, value*idf AS value FROM raw JOIN idf USING (target)),
smoothed AS (SELECT entity, t2 AS target, sum(w.value*rel.value) AS value FROM weighted w JOIN rel ON t1=target
 GROUP BY 1,2 HAVING abs(sum(w.value*rel.value)) > 1e-12)"""
