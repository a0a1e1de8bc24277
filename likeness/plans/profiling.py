"""Sparse profiles, relatedness, pair draws and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from likeness.functions import fingerprints as FP
from likeness.operators import lineage as L
from likeness.operators import profiles as P
from likeness.operators import splits as O
from likeness.operators.groups import near_groups
from likeness.operators.sampling import group_pairs, random_pairs
from likeness.plans import sqlparts as Q
from likeness.plans.base import (
    NATION_CALLS, PROFILES, SPARSE_CALLS, nation_calls, nation_profiles, nation_relatedness,
    nation_targets, sparse_calls,
)
from likeness.plans.likenesses import hashed
from likeness.plans.registry import query
from likeness.session import cut_lineage
from likeness.sources.tables import spread

r6 = lambda c: F.round(c, 6).alias(c)


@query("raw_profiles", f"WITH {NATION_CALLS} SELECT entity, target, round(value,6) AS value FROM calls "
       "WHERE target IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name <> 'ASIA')")
def _(t):
    regions = t.region.filter("r_name <> 'ASIA'")
    known = t.nation.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    targets = known.select(F.col("n_nationkey").cast("long").alias("target"))
    return P.raw_profiles(nation_calls(t), targets).select("entity", "target", r6("value"))


@query("target_idf", f"WITH {PROFILES} SELECT target, hits, round(idf,6) AS idf FROM idf")
def _(t):
    raw = P.raw_profiles(nation_calls(t), nation_targets(t))
    return P.target_idf(raw).withColumn("idf", F.round("idf", 6))


@query("idf_weight", f"WITH {PROFILES} SELECT entity, target, round(value,6) AS value FROM weighted")
def _(t):
    raw = P.raw_profiles(nation_calls(t), nation_targets(t))
    return P.idf_weight(raw, P.target_idf(raw)).withColumn("value", F.round("value", 6))


@query("smooth_profiles", f"WITH {PROFILES} SELECT entity, target, round(value,6) AS value FROM smoothed")
def _(t):
    return nation_profiles(t)[1].withColumn("value", F.round("value", 6))


@query("row_norms", f"WITH {SPARSE_CALLS} SELECT entity, round(sqrt(sum(value*value)),6) AS norm FROM calls GROUP BY 1")
def _(t):
    return P.row_norms(sparse_calls(t)).withColumn("norm", F.round("norm", 6))


@query("matrix_density", f"WITH {SPARSE_CALLS} SELECT count(*) AS nnz, count(DISTINCT entity)*count(DISTINCT target) AS size, "
       "round(count(*)/(count(DISTINCT entity)*count(DISTINCT target)),6) AS density FROM calls")
def _(t):
    return P.density(sparse_calls(t), "entity", "target").withColumn("density", F.round("density", 6))


EVERY = "ents AS (SELECT DISTINCT entity FROM raw)"
BG = ",\n".join([PROFILES, EVERY, Q.random_pairs("rp", "ents", "entity", 10, "bg"),
                 Q.cosine("cs", "rp", "smoothed"), Q.bins("bn", "smoothed"),
                 "smp AS (SELECT rp.draw, a, b, raw FROM rp JOIN cs USING (a, b))",
                 Q.background("smp", "bn")])


@query("random_pairs", f"WITH {NATION_CALLS}, ents AS (SELECT DISTINCT entity FROM calls), "
       + Q.random_pairs("rp", "ents", "entity", 10, "bg") + " SELECT draw, a, b FROM rp")
def _(t):
    return random_pairs(nation_calls(t).select("entity").distinct(), "entity", 10, "bg")


@query("sample_per_group_capped",
       "WITH members AS (SELECT DISTINCT l_suppkey AS grp, l_partkey AS part FROM lineitem), "
       + Q.group_pairs("gp", "members", "grp", "part", "grp") + " SELECT grp, draw, a, b FROM gp")
def _(t):
    members = t.lineitem.select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("part")).distinct()
    return group_pairs(members, "grp", "part", "grp")


@query("cooccur_pairs", f"WITH {SPARSE_CALLS}, pos AS (SELECT target, entity FROM calls WHERE value > 0), "
       + Q.group_pairs("gp", "pos", "target", "entity", "co")
       + " SELECT target, draw, a, b FROM gp")
def _(t):
    positive = sparse_calls(t).filter("value > 0")
    return group_pairs(positive, "target", "entity", "co")


@query("sparse_cosine_pairs", f"WITH {PROFILES}, {EVERY}, " + Q.random_pairs("rp", "ents", "entity", 10, "bg") + ", "
       + Q.cosine("cs", "rp", "smoothed") + " SELECT a, b, round(raw,6) AS raw FROM cs")
def _(t):
    raw, smoothed = nation_profiles(t)
    pairs = random_pairs(raw.select("entity").distinct(), "entity", 10, "bg")
    return P.cosine_of_pairs(pairs, smoothed).withColumn("raw", F.round("raw", 6))


@query("background_stats", f"WITH {BG} SELECT bin_a::BIGINT AS bin_a, bin_b::BIGINT AS bin_b, n, round(mean,6) AS mean, round(std,6) AS std FROM bg_stats")
def _(t):
    raw, smoothed = nation_profiles(t)
    sample = P.background_sample(raw.select("entity").distinct(), P.unit_rows(smoothed), 10, "bg")
    return P.background_stats(sample).select(
        F.col("bin_a").cast("long").alias("bin_a"), F.col("bin_b").cast("long").alias("bin_b"),
        "n", r6("mean"), r6("std"))


POS = "pos AS (SELECT target, entity FROM calls WHERE value > 0)"


@query("size_matched_z", f"WITH {BG}, {POS}, " + Q.group_pairs("gp", "pos", "target", "entity", "co") + ", "
       + Q.cosine("gc", "gp", "smoothed") + """,
gb AS (SELECT g.*, coalesce(x.bin,0) AS bin_a, coalesce(y.bin,0) AS bin_b FROM gc g
 LEFT JOIN bn x ON x.entity=a LEFT JOIN bn y ON y.entity=b)
SELECT a, b, round(raw,6) AS raw, round((raw - coalesce(s.mean, o.mean))/coalesce(s.std, o.std),5) AS z
FROM gb LEFT JOIN bg_stats s USING (bin_a, bin_b) CROSS JOIN bg_all o""")
def _(t):
    raw, smoothed = nation_profiles(t)
    pairs = group_pairs(raw.filter("value > 0"), "target", "entity", "co")
    units = P.unit_rows(smoothed)
    scored = P.with_cosine(pairs.select("a", "b").distinct(), units)
    sample = P.background_sample(raw.select("entity").distinct(), units, 10, "bg")
    return P.size_matched_z(scored, sample).select("a", "b", r6("raw"), F.round("z", 5).alias("z"))


# --- relatedness --------------------------------------------------------------

PART_PATH = "list_value(p_type, p_brand, split_part(p_name,' ',1), split_part(p_name,' ',2))"
CLASSES = f"cls AS (SELECT {PART_PATH} AS path, count(*) AS members FROM part GROUP BY 1)"
SHARED = ("(CASE WHEN x.path[1]<>y.path[1] THEN 0 WHEN x.path[2]<>y.path[2] THEN 1 "
          "WHEN x.path[3]<>y.path[3] THEN 2 WHEN x.path[4]<>y.path[4] THEN 3 ELSE 4 END)::BIGINT")


def part_paths(t):
    words = F.split("p_name", " ")
    return t.part.select(F.array("p_type", "p_brand", words[0], words[1]).alias("path"))


@query("lineage_similarity", f"""WITH {CLASSES}, pr AS (SELECT array_to_string(x.path,'/') AS path_a, array_to_string(y.path,'/') AS path_b,
 {SHARED} AS depth, CASE WHEN x.path=y.path THEN x.members*(x.members-1)//2 ELSE x.members*y.members END AS pairs
 FROM cls x JOIN cls y ON x.path[1]=y.path[1] AND x.path[2]=y.path[2] AND x.path[3]=y.path[3]
 AND array_to_string(x.path,chr(1)) <= array_to_string(y.path,chr(1)))
SELECT path_a, path_b, depth, round(least(depth,6)/6.0,6) AS value, pairs::BIGINT AS pairs FROM pr WHERE pairs > 0""")
def _(t):
    pairs = L.class_pairs(L.path_classes(part_paths(t)), min_depth=3)
    return pairs.select(
        F.array_join("path_a", "/").alias("path_a"), F.array_join("path_b", "/").alias("path_b"), "depth",
        F.round(F.least("depth", F.lit(6)) / 6.0, 6).alias("value"), "pairs")


@query("bucketed_self_join", """WITH cls AS (SELECT p_type, p_brand, count(*) AS members FROM part GROUP BY ALL)
SELECT x.p_type || '/' || x.p_brand AS path_a, y.p_type || '/' || y.p_brand AS path_b,
 CASE WHEN x.p_brand=y.p_brand THEN x.members*(x.members-1)//2 ELSE x.members*y.members END::BIGINT AS pairs
FROM cls x JOIN cls y ON x.p_type=y.p_type AND x.p_brand <= y.p_brand
WHERE x.p_brand <> y.p_brand OR x.members > 1""")
def _(t):
    classes = L.path_classes(t.part.select(F.array("p_type", "p_brand").alias("path")))
    return L.class_pairs(classes, min_depth=1).select(
        F.array_join("path_a", "/").alias("path_a"), F.array_join("path_b", "/").alias("path_b"), "pairs")


@query("max_merge", """WITH fam AS (SELECT a.n_nationkey AS t1, b.n_nationkey AS t2, 0.5::DOUBLE AS value
  FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey < b.n_nationkey),
 lane AS (SELECT t1, t2, 0.75::DOUBLE AS value FROM (SELECT s_nationkey AS t1, c_nationkey AS t2, sum(l_quantity) AS q FROM lineitem
  JOIN supplier ON l_suppkey=s_suppkey JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  GROUP BY 1, 2) QUALIFY q > avg(q) OVER ()),
 st AS (SELECT n_nationkey AS t1, n_nationkey AS t2, 1.0::DOUBLE AS value FROM nation
  UNION ALL SELECT * FROM fam UNION ALL SELECT t2, t1, value FROM fam
  UNION ALL SELECT * FROM lane UNION ALL SELECT t2, t1, value FROM lane)
SELECT t1::BIGINT AS t1, t2::BIGINT AS t2, max(value) AS value FROM st GROUP BY 1, 2 HAVING max(value) <> 0""")
def _(t):
    from likeness.plans.base import nation_lineages

    family = L.lineage_similarity(nation_lineages(t), 1, 2)
    carried = (
        t.lineitem
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").cast("long").alias("t1"), F.col("c_nationkey").cast("long").alias("t2"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    # Lanes that carry more than the average one; at most nations x nations rows meet in the window.
    lanes = carried.withColumn("mean", F.avg("q").over(Window.partitionBy(F.lit(0)))).filter("q > mean").select(
        "t1", "t2", F.lit(0.75).alias("value"))
    return L.max_merge([family, lanes], nation_targets(t))


# --- splits -------------------------------------------------------------------


def plain_features(text):
    """n-grams of a text without regard to numbers, case and white space, as hashes; none for NULL."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]+", "#")
    return hashed(FP.features(FP.tokens(plain), "ngram2"))


NEAR = 0.8
NEAR_GROUPS = f"""gt AS MATERIALIZED (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text,''),'[0-9]+','#','g')),
 '[ \\n\\t\\r]+'), lambda x: x <> '') AS w FROM documents),
{Q.features('gf', 'gt')}, {Q.close_pairs('gl', 'gf', NEAR)},
reach AS (SELECT id AS a, id AS b FROM gt UNION SELECT reach.a, gl.b FROM reach JOIN gl ON gl.a = reach.b),
none AS (SELECT min(id) AS grp FROM gt WHERE id NOT IN (SELECT id FROM gf)),
dg AS MATERIALIZED (SELECT gt.id AS doc_id, coalesce(CASE WHEN gt.id NOT IN (SELECT id FROM gf) THEN none.grp END, r.grp) AS grp
 FROM gt JOIN (SELECT a, min(b) AS grp FROM reach GROUP BY 1) r ON r.a = gt.id CROSS JOIN none)"""


def docs_grouped(t):
    """(doc_id, grp): texts linked by a similarity of NEAR, also through others, are one group."""
    # Made twice from the texts, which are a third of their features: these would lie on disk beside their own shuffles.
    sets = spread(t.documents).select(F.col("doc_id").alias("id"), plain_features(F.col("text")).alias("feats"))
    return near_groups(sets, NEAR).select(F.col("id").alias("doc_id"), F.col("group").alias("grp"))


@query("group_key", f"WITH RECURSIVE {NEAR_GROUPS} SELECT doc_id, grp FROM dg")
def _(t):
    return docs_grouped(t)


DOC_SPLIT = f"""{NEAR_GROUPS},
gs AS (SELECT grp, count(*) AS size FROM dg GROUP BY 1),
cum AS (SELECT grp, coalesce(sum(size) OVER (ORDER BY md5(concat_ws('|',grp,'split')), grp
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM gs),
sp AS (SELECT doc_id, grp, CASE WHEN before < floor((SELECT count(*) FROM documents)*0.2) THEN 1 ELSE 0 END::BIGINT AS split
 FROM dg JOIN cum USING (grp))"""


@query("group_disjoint_split", f"WITH RECURSIVE {DOC_SPLIT} SELECT doc_id, grp, split FROM sp")
def _(t):
    return O.group_disjoint_split(cut_lineage(docs_grouped(t), "groups"), "grp").select(
        "doc_id", "grp", F.col("split").cast("long").alias("split"))


@query("split_leak_audit", f"""WITH RECURSIVE {DOC_SPLIT} SELECT count(*) FILTER (split=0) AS train, count(*) FILTER (split=1) AS test,
 (SELECT count(*) FROM (SELECT grp FROM sp GROUP BY grp HAVING count(DISTINCT split) > 1)) AS leaking_groups FROM sp""")
def _(t):
    return O.split_audit(O.group_disjoint_split(cut_lineage(docs_grouped(t), "groups"), "grp"), "grp")


@query("first_fit_split", """WITH RECURSIVE gs AS (SELECT o_custkey AS grp, count(*) AS size FROM orders GROUP BY 1),
h AS (SELECT size, count(*) AS groups, row_number() OVER (ORDER BY size DESC) AS k FROM gs GROUP BY size),
w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS size, 0::BIGINT AS fit, floor((SELECT count(*) FROM orders)*0.7)::BIGINT AS room
 UNION ALL SELECT h.k, h.size, least(h.groups, w.room // h.size), w.room - h.size*least(h.groups, w.room // h.size)
 FROM w JOIN h ON h.k = w.k + 1),
ix AS (SELECT grp, size, row_number() OVER (PARTITION BY size ORDER BY md5(concat_ws('|',grp,'fit')), grp) - 1 AS pos FROM gs)
SELECT o_orderkey, (CASE WHEN ix.pos < w.fit THEN 0 ELSE 1 END)::BIGINT AS split
FROM orders JOIN ix ON grp=o_custkey JOIN w ON w.size=ix.size""")
def _(t):
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("grp"))
    groups = O.first_fit_groups(O.group_sizes(orders, "grp"), "grp")
    return orders.join(groups, "grp").select("o_orderkey", F.col("split").cast("long").alias("split"))
