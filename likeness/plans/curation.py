"""Scans, predicates, relational joins, calls and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions.draws import digest
from likeness.functions import scalars as S
from likeness.operators import calls as C
from likeness.operators.curate import Rules, curate_censored, curate_exact
from likeness.operators.ordering import quantile, sample_n
from likeness.plans.base import (
    MEAS, NATION_CALLS, RULES, SPARSE_CALLS, STRICT_RULES, branches, measurements, nation_calls, sparse_calls,
)
from likeness.plans.registry import query

# --- predicates ---------------------------------------------------------------

STRICT = """ FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey
WHERE l_discount < 0.10 AND l_linenumber <> 6 AND NOT (l_linenumber = 5 AND o_orderstatus = 'O')
 AND l_returnflag IN ('A','R') AND o_orderstatus IN ('F','O') AND o_orderpriority <> '3-MEDIUM' AND s_nationkey % 5 <> 4
 AND (CASE WHEN o_orderpriority='5-LOW' THEN 'Inconclusive'
  WHEN o_orderpriority<>'4-NOT SPECIFIED' THEN 'Active' END IS NULL OR o_orderpriority <> '5-LOW')"""


@query("curate_exact", "SELECT l_partkey AS entity, l_suppkey AS supplier, l_returnflag AS type, "
       "4.0::DOUBLE + l_quantity/20.0::DOUBLE AS potency" + STRICT
       + " AND l_tax < 0.07 AND l_linenumber <> 7")
def _(t):
    return curate_exact(measurements(t, strict=True), STRICT_RULES).select(
        "entity", "supplier", "type", "potency")


@query("curate_censored", "SELECT l_partkey AS entity, l_suppkey AS supplier, l_returnflag AS type, "
       "round(9.0::DOUBLE - log10(l_extendedprice), 6) AS bound" + STRICT
       + " AND l_tax >= 0.07 AND l_extendedprice > 0")
def _(t):
    return curate_censored(measurements(t, strict=True), STRICT_RULES).select(
        "entity", "supplier", "type", F.round("bound", 6).alias("bound"))


EVENT_K = "(props->>'$.k')"


@query("null_safe_not_in", f"""
SELECT event_id, comment FROM (SELECT event_id,
 CASE WHEN {EVENT_K}::BIGINT % 5 <> 0 THEN upper(event_type) END AS comment FROM events)
WHERE comment IS NULL OR lower(comment) NOT IN ('error','view')""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    comment = F.when(k % 5 != 0, F.upper("event_type"))
    return (t.events.select("event_id", comment.alias("comment"))
            .filter(S.null_safe_not_in("comment", ("error", "view"))))


@query("conditions_hash", """
SELECT ach, count(*) AS n FROM (SELECT substr(md5(concat_ws('|', coalesce(o_orderpriority,''),
 coalesce(l_linestatus,''), coalesce(o_orderstatus,''), coalesce(l_returnflag,''),
 coalesce(CASE WHEN l_linenumber < 4 THEN l_linenumber::VARCHAR END,''), coalesce(l_suppkey::VARCHAR,''))),1,16) AS ach
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey) GROUP BY ach""")
def _(t):
    early = F.when(F.col("l_linenumber") < 4, F.col("l_linenumber"))
    ach = S.conditions_hash("o_orderpriority", "l_linestatus", "o_orderstatus", "l_returnflag",
                            early, "l_suppkey")
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(ach.alias("ach")).agg(F.count("*").alias("n"))


@query("bound_from_value", """
SELECT l_orderkey, l_linenumber, round(9.0::DOUBLE - log10(l_extendedprice), 6) AS bound
FROM lineitem WHERE l_extendedprice > 0""")
def _(t):
    return t.lineitem.filter("l_extendedprice > 0").select(
        "l_orderkey", "l_linenumber", F.round(S.bound_from_value("l_extendedprice"), 6).alias("bound"))


@query("grade_ramp", """
SELECT l_orderkey, l_linenumber, round(2.0 * least(greatest((4.0 + l_quantity/20.0 - 4.5)/1.5,
 0.0::DOUBLE), 1.0::DOUBLE) - 1.0, 6) AS grade FROM lineitem""")
def _(t):
    potency = F.lit(4.0) + F.col("l_quantity") / 20.0
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.round(S.grade_ramp(potency), 6).alias("grade"))


@query("log_transforms", """
SELECT l_orderkey, l_linenumber, round(log10(greatest(v, 1e-6)), 6) AS floored,
 round(CASE WHEN v > 0 THEN log10(v) ELSE v END, 6) AS positive,
 round(log10(greatest(v, 0.0) + 1.0), 6) AS plus_one
FROM (SELECT *, l_extendedprice - 20000.0 * l_linenumber AS v FROM lineitem)""")
def _(t):
    v = F.col("l_extendedprice") - 20000.0 * F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(S.log_floor(v), 6).alias("floored"),
        F.round(S.log_positive(v), 6).alias("positive"), F.round(S.log_plus_one(v), 6).alias("plus_one"))


@query("coerce_finite", f"""
SELECT event_id, x FROM (SELECT event_id, TRY_CAST(CASE {EVENT_K}::BIGINT % 4 WHEN 0 THEN {EVENT_K}
 WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' ELSE 'Infinity' END AS DOUBLE) AS x FROM events)
WHERE x IS NOT NULL AND isfinite(x)""")
def _(t):
    k = F.get_json_object("props", "$.k")
    r = k.cast("long") % 4
    text = F.when(r == 0, k).when(r == 1, "n/a").when(r == 2, "NaN").otherwise("Infinity")
    return t.events.select("event_id", S.finite(text).alias("x")).filter("x IS NOT NULL")


@query("extract_number", """
SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '([0-9.]+)', 1), '') AS DOUBLE) AS number FROM pages""")
def _(t):
    return t.pages.select("page_id", S.extract_number("url").alias("number"))


@query("min_group_filter", f"WITH {SPARSE_CALLS} " + """
SELECT entity, target, round(value,6) AS value FROM calls WHERE entity IN
 (SELECT entity FROM calls GROUP BY entity HAVING count(*) >= 25)""")
def _(t):
    return C.min_group(sparse_calls(t), "entity", 25).select(
        "entity", "target", F.round("value", 6).alias("value"))


@query("dropna_dedup_sample", """
WITH u AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE n_chars IS NOT NULL GROUP BY text)
SELECT u.doc_id, d.lang FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, 'cap')), doc_id) AS rn FROM u) u
 JOIN documents d USING (doc_id) WHERE rn <= 150""")
def _(t):
    docs = t.documents.dropna(subset=["n_chars"])
    unique = docs.groupBy(F.md5("text").alias("content")).agg(
        F.min_by("lang", "doc_id").alias("lang"), F.min("doc_id").alias("doc_id"))
    return sample_n(unique, "doc_id", 150, "cap").select("doc_id", "lang")


@query("sanitise_clip", f"""
SELECT event_id, CASE WHEN NOT isfinite(raw) THEN 0.0 ELSE least(greatest(raw, -1e12), 1e12) END AS clean
FROM (SELECT event_id, CASE {EVENT_K}::BIGINT % 10 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE
 WHEN 2 THEN '-Infinity'::DOUBLE WHEN 3 THEN value * 1e13 WHEN 4 THEN -1e14 ELSE value END AS raw FROM events)""")
def _(t):
    r = F.get_json_object("props", "$.k").cast("long") % 10
    raw = (F.when(r == 0, float("nan")).when(r == 1, float("inf")).when(r == 2, float("-inf"))
           .when(r == 3, F.col("value") * 1e13).when(r == 4, -1e14).otherwise(F.col("value")))
    return t.events.select("event_id", S.sanitise(raw).alias("clean"))


# --- joins --------------------------------------------------------------------


@query("star_join", """
SELECT l_orderkey, l_partkey, s_nationkey, o_orderpriority, l_quantity FROM lineitem
JOIN orders ON o_orderkey=l_orderkey JOIN supplier ON s_suppkey=l_suppkey
WHERE o_orderstatus='F' AND l_discount < 0.10""")
def _(t):
    return (t.lineitem.filter("l_discount < 0.10")
            .join(t.orders.filter("o_orderstatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
            .select("l_orderkey", "l_partkey", "s_nationkey", "o_orderpriority", "l_quantity"))


@query("dim_join", """
SELECT p_partkey, p_name, l_orderkey, l_quantity FROM part JOIN lineitem ON l_partkey=p_partkey
WHERE p_name IS NOT NULL AND p_size <= 25""")
def _(t):
    return (t.part.filter("p_name IS NOT NULL AND p_size <= 25")
            .join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
            .select("p_partkey", "p_name", "l_orderkey", "l_quantity"))


@query("bridge_join", """
SELECT s_suppkey, concat_ws('  ', r_name, n_name, s_name) AS lineage FROM supplier
JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""")
def _(t):
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.concat_ws("  ", "r_name", "n_name", "s_name").alias("lineage")))


@query("left_join_present", """
SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def _(t):
    labelled = t.labels.filter("quality IS NOT NULL")
    return t.documents.select("doc_id", "lang").join(labelled, "doc_id")


@query("semi_join_keys", """
SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN
 (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def _(t):
    rich = t.supplier.filter("s_acctbal > 5000")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(
        rich, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")


# --- calls --------------------------------------------------------------------


@query("replicate_stats", f"WITH {NATION_CALLS} " + """
SELECT entity, target, type, ach, round(median,6) AS median, low, high, size FROM stats""")
def _(t):
    exact, _c = branches(t, "nation", "line_status")
    return C.replicate_stats(exact, ["entity", "target", "type", "ach"], "potency").withColumn(
        "median", F.round("median", 6))


@query("spread_filter", f"WITH {NATION_CALLS} SELECT entity, target, type, ach, size FROM kept")
def _(t):
    exact, _c = branches(t, "nation", "line_status")
    stats = C.replicate_stats(exact, ["entity", "target", "type", "ach"], "potency")
    return C.spread_filter(stats).select("entity", "target", "type", "ach", "size")


@query("best_evidence", f"WITH {NATION_CALLS} "
       "SELECT entity, target, type, ach, size, round(median,6) AS median FROM best")
def _(t):
    exact, _c = branches(t, "nation", "line_status")
    stats = C.spread_filter(C.replicate_stats(exact, ["entity", "target", "type", "ach"], "potency"))
    return C.best_evidence(stats, ["entity", "target"], ["type", "ach"]).withColumn(
        "median", F.round("median", 6))


@query("censored_bound", f"WITH {SPARSE_CALLS} SELECT entity, target, round(bound,6) AS bound FROM bounds")
def _(t):
    _e, censored = branches(t, "supplier")
    return C.censored_bounds(censored, ["entity", "target"]).withColumn("bound", F.round("bound", 6))


@query("precedence_dedup", f"WITH {NATION_CALLS} SELECT entity, target, round(value,6) AS value, source FROM calls")
def _(t):
    return nation_calls(t).select("entity", "target", F.round("value", 6).alias("value"), "source")


@query("activity_calls", f"WITH {SPARSE_CALLS} SELECT entity, target, round(value,6) AS value, source FROM calls")
def _(t):
    return sparse_calls(t).withColumn("value", F.round("value", 6))


@query("distinct_counts", f"WITH {MEAS} " + """
SELECT count(*) AS n_rows, count(DISTINCT entity) AS entities, count(DISTINCT supplier) AS targets,
 count(DISTINCT ach) AS condition_groups FROM meas WHERE l_tax < 0.07""")
def _(t):
    exact = curate_exact(measurements(t), RULES)
    return exact.agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("entities"),
                     F.count_distinct("supplier").alias("targets"),
                     F.count_distinct("ach").alias("condition_groups"))


@query("annotation_histogram", f"WITH {NATION_CALLS}, s AS (SELECT count(*) AS n FROM calls GROUP BY entity) " + """
SELECT CASE WHEN n=1 THEN '1' WHEN n=2 THEN '2' WHEN n<=4 THEN '3-4' WHEN n<=9 THEN '5-9'
 WHEN n<=19 THEN '10-19' ELSE '20+' END AS targets, count(*) AS entities FROM s GROUP BY 1""")
def _(t):
    return C.annotation_histogram(nation_calls(t))


# --- keyed selection, unions, samples -----------------------------------------


@query("longest_per_key", """
SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, length(text) AS n_chars,
 row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id DESC) AS rn FROM documents) WHERE rn=1""")
def _(t):
    order = F.struct(F.length("text"), "doc_id")
    pick = F.max_by(F.struct("doc_id", F.length("text").cast("long").alias("n_chars")), order)
    return t.documents.groupBy("source").agg(pick.alias("p")).select("source", "p.doc_id", "p.n_chars")


@query("tagged_union", """
SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM
 (SELECT text, 'document' AS source FROM documents UNION ALL SELECT text, 'benchmark' FROM benchmark
  UNION ALL SELECT text, 'conversation' FROM conversations) GROUP BY source""")
def _(t):
    stacked = (t.documents.select("text", F.lit("document").alias("source"))
               .unionByName(t.benchmark.select("text", F.lit("benchmark").alias("source")))
               .unionByName(t.conversations.select("text", F.lit("conversation").alias("source"))))
    return stacked.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("union_distinct_text", """
SELECT md5(text) AS content, length(text)::BIGINT AS chars FROM
 (SELECT text FROM documents UNION SELECT text FROM benchmark)""")
def _(t):
    both = t.documents.select("text").union(t.benchmark.select("text"))
    return both.select(F.md5("text").alias("content"), F.length("text").cast("long").alias("chars")).distinct()


@query("stack_train_test", """
WITH s AS (SELECT conv_id AS id, text, 1 AS phase FROM conversations WHERE role='user'
 UNION ALL SELECT conv_id, text, 2 FROM conversations WHERE role='assistant'),
d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY phase, id) AS rn FROM s WHERE text IS NOT NULL)
SELECT md5(text) AS content, id, phase FROM d WHERE rn=1""")
def _(t):
    side = lambda role, n: t.conversations.filter(F.col("role") == role).select(
        F.col("conv_id").alias("id"), "text", F.lit(n).alias("phase"))
    stacked = side("user", 1).unionByName(side("assistant", 2)).dropna(subset=["text"])
    keyed = stacked.select(F.md5("text").alias("content"), "id", "phase")
    return C.first_source(keyed, ["content"], F.struct("phase", "id"))


@query("sample_n", """
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
 (ORDER BY md5(concat_ws('|', o_orderkey, '7')), o_orderkey) AS rn FROM orders) WHERE rn <= 1000""")
def _(t):
    return sample_n(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 7)


@query("quantile_threshold", """
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.75),6) AS q75,
 round(quantile_cont(o_totalprice, 0.4),6) AS q40 FROM orders GROUP BY 1""")
def _(t):
    # One percentile call would hold a whole group; this ranks counted values.
    q = lambda p, out: quantile(t.orders, ["o_orderpriority"], "o_totalprice", p, out)
    return q(0.75, "q75").join(q(0.4, "q40"), "o_orderpriority").select(
        "o_orderpriority", F.round("q75", 6).alias("q75"), F.round("q40", 6).alias("q40"))
