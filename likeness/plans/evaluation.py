"""From calls to scored pairs: how well a representation tells alike entities.

Entities are parts, described by type, brand, the two words of the name and a
size class; their measured side is the profile over suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions import fingerprints as FP
from likeness.functions import vectors as V
from likeness.operators import metrics as M
from likeness.operators import profiles as P
from likeness.operators.calls import first_source
from likeness.operators.closeness import near_records
from likeness.operators.neighbours import neighbour_profile
from likeness.operators.sampling import group_pairs, random_pairs
from likeness.operators.similarity import tanimoto_of_pairs
from likeness.operators.splits import group_disjoint_split, group_key
from likeness.plans import sqlparts as Q
from likeness.plans.base import CLOSE, SUPPLIER_PROFILES, supplier_profiles
from likeness.plans.likenesses import hashed
from likeness.plans.registry import query
from likeness.session import cut_lineage

RELATED = M.RELATED_Z
#: A floor that any shared feature is above.
ANY = 1e-6
r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def part_words(t):
    words = F.split("p_name", " ")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.array("p_type", "p_brand", words[0], words[1],
                F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string"))).alias("words"))


def part_prints(t, kind="ngram2"):
    return part_words(t).select("id", FP.bits(F.col("words"), kind).alias("bits"))


class Study:
    """The intermediate tables of one evaluation, each written once."""

    def __init__(self, t):
        self.t = t
        self.raw, self.smoothed = supplier_profiles(t)
        profiled = self.raw.select("entity").distinct()
        parts = t.part.select(F.col("p_partkey").alias("entity"), group_key(F.concat("p_brand", "p_type")).alias("grp"))
        split = group_disjoint_split(parts.join(profiled, "entity", "left_semi"), "grp", 0.2, "parts")
        self.entities = cut_lineage(split.select("entity", "split"), "entities")
        self.eligible = self.entities.filter("split = 1").select("entity")
        self.prints = cut_lineage(part_prints(t), "prints")

    def drawn(self, floor=CLOSE):
        """(a, b, source): three kinds of test pairs, one row per ordered pair; structural ones reach ``floor``."""
        positive = self.raw.filter("value > 0").join(self.eligible, "entity", "left_semi")
        shared = group_pairs(positive, "target", "entity", "shared").select("a", "b", F.lit("shared_target").alias("source"))
        own = part_words(self.t).select("id", hashed(FP.features(F.col("words"), "ngram2")).alias("feats")).join(
            self.eligible.toDF("id"), "id", "left_semi")
        close = near_records(cut_lineage(own, "features"), 8, floor, 0.999).select("a", "b", F.lit("structural").alias("source"))
        random = random_pairs(self.eligible, "entity", 20, "rand").select("a", "b", F.lit("random").alias("source"))
        order = F.when(F.col("source") == "shared_target", 0).when(F.col("source") == "structural", 1).otherwise(2)
        stacked = shared.unionByName(close).unionByName(random)
        return first_source(stacked, ["a", "b"], order)

    def pairs(self, floor=CLOSE):
        """(a, b, source, raw, z, sim): the teacher's view beside the structural one."""
        drawn = cut_lineage(self.drawn(floor), "pairs")
        units = P.unit_rows(self.smoothed)
        sample = P.background_sample(self.entities.select("entity"), units, 10, "bg")
        z = P.size_matched_z(P.with_cosine(drawn, units), sample)
        with_sim = tanimoto_of_pairs(z, self.prints)
        return cut_lineage(with_sim.select("a", "b", "source", *r6("raw", "z", "sim")), "teacher")


TEACHER = ",\n".join([
    SUPPLIER_PROFILES,
    """prof AS (SELECT p_partkey AS entity, p_brand||p_type AS grp FROM part WHERE p_partkey IN (SELECT entity FROM raw)),
gs AS (SELECT grp, count(*) AS size FROM prof GROUP BY 1),
cum AS (SELECT grp, coalesce(sum(size) OVER (ORDER BY md5(concat_ws('|',grp,'parts')), grp
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM gs),
ents AS MATERIALIZED (SELECT entity, CASE WHEN before < floor((SELECT count(*) FROM prof)*0.2) THEN 1 ELSE 0 END AS split FROM prof JOIN cum USING (grp)),
el AS MATERIALIZED (SELECT entity FROM ents WHERE split=1),
ptok AS MATERIALIZED (SELECT p_partkey AS id, [p_type, p_brand, split_part(p_name,' ',1), split_part(p_name,' ',2), 'size'||(p_size//10)] AS w FROM part)""",
    Q.fp("pfp", "ptok"),
    Q.features("pft", "ptok"), "eft AS MATERIALIZED (SELECT * FROM pft WHERE id IN (SELECT entity FROM el))",
    "pos AS (SELECT target, entity FROM raw WHERE value > 0 AND entity IN (SELECT entity FROM el))",
    Q.group_pairs("gp", "pos", "target", "entity", "shared"),
    Q.close_pairs("ts", "eft", CLOSE),
    "st AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rk FROM ts WHERE sim <= 0.999) WHERE rk <= 8)",
    Q.random_pairs("rnd", "el", "entity", 20, "rand"),
    """prs AS MATERIALIZED (SELECT a, b, CASE min(o) WHEN 0 THEN 'shared_target' WHEN 1 THEN 'structural' ELSE 'random' END AS source FROM
 (SELECT a, b, 0 AS o FROM gp UNION ALL SELECT a, b, 1 FROM st UNION ALL SELECT a, b, 2 FROM rnd) GROUP BY 1,2)""",
    Q.random_pairs("rp", "ents", "entity", 10, "bg"), Q.cosine("bc", "rp", "smoothed"), Q.bins("bn", "smoothed"),
    "smp AS (SELECT rp.draw, a, b, raw FROM rp JOIN bc USING (a, b))", Q.background("smp", "bn"),
    Q.cosine("pc", "prs", "smoothed"), Q.tanimoto_pairs("ps", "prs", "pfp"),
    """tea AS MATERIALIZED (SELECT p.a, p.b, p.source, round(c.raw,6) AS raw, round(sim,6) AS sim,
 round((c.raw - coalesce(g.mean, o.mean))/coalesce(g.std, o.std),6) AS z FROM prs p JOIN pc c USING (a, b) JOIN ps USING (a, b)
 LEFT JOIN bn x ON x.entity=a LEFT JOIN bn y ON y.entity=b
 LEFT JOIN bg_stats g ON g.bin_a=coalesce(x.bin,0) AND g.bin_b=coalesce(y.bin,0) CROSS JOIN bg_all o)""",
])


#: The same with the nearest parts of each, however far they are.
WHOLE = TEACHER.replace(Q.close_pairs("ts", "eft", CLOSE), Q.close_pairs("ts", "eft", 0))


@query("teacher_pairs", f"WITH {WHOLE} SELECT a, b, source, raw, z, sim FROM tea")
def _(t):
    return Study(t).pairs(ANY)


@query("source_means", f"WITH {WHOLE} SELECT source, count(*) AS n, round(avg(raw),5) AS raw, round(avg(sim),5) AS sim FROM tea GROUP BY 1")
def _(t):
    return Study(t).pairs(ANY).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("raw"), 5).alias("raw"), F.round(F.avg("sim"), 5).alias("sim"))


def used(pairs):
    """Entities that occur on either side of any pair."""
    return pairs.select(F.col("a").alias("entity")).union(pairs.select("b")).distinct()


@query("row_is_used", f"WITH {TEACHER}, us AS (SELECT a AS entity FROM prs UNION SELECT b FROM prs) SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT entity FROM us)")
def _(t):
    pairs = Study(t).drawn()
    return t.part.select("p_partkey", "p_name").join(used(pairs).toDF("p_partkey"), "p_partkey", "left_semi")


@query("regime_label", f"""WITH {TEACHER}, rg AS (SELECT *, 'overall' AS regime FROM tea UNION ALL SELECT *, 'scaffold_hop' FROM tea WHERE sim < 0.35
 UNION ALL SELECT *, 'cliff' FROM tea WHERE sim > 0.60) SELECT regime, count(*) AS n, count(*) FILTER (z >= {RELATED}) AS related FROM rg GROUP BY 1""")
def _(t):
    return M.with_regimes(Study(t).pairs(), "sim").groupBy("regime").agg(
        F.count("*").alias("n"), F.count_if(F.col("z") >= RELATED).alias("related"))


KINDS = ("ngram2", "ngram3", "class", "pair")


def method_scores(study, pairs):
    """(method, a, b, z, sim, score): every representation on the same pairs."""
    t = study.t
    base = pairs.select("a", "b", "z", "sim")
    out = []
    for kind in KINDS:
        scored = tanimoto_of_pairs(base, part_prints(t, kind), "score")
        out.append(scored.withColumn("method", F.lit(kind)))
    numbers = {
        "size": F.col("p_size").cast("double"), "price": F.col("p_retailprice"),
        "name": F.length("p_name").cast("double"), "brand": F.length("p_brand").cast("double")}
    stats = t.part.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(n) for n, c in numbers.items()])).scalar()
    scaled = F.array(*[(c - stats[n]["m"]) / (stats[n]["s"] + 1e-8) for n, c in numbers.items()])
    v = t.part.select(F.col("p_partkey").alias("id"), scaled.alias("v"))
    joined = base.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    out.append(joined.select("a", "b", "z", "sim", V.cosine(F.col("va"), F.col("vb")).alias("score"),
                             F.lit("descriptors").alias("method")))
    queries = study.prints.join(used(pairs).toDF("id"), "id", "left_semi")
    train = study.entities.filter("split = 0").select(F.col("entity").alias("id"))
    inferred = neighbour_profile(queries, study.prints.join(train, "id", "left_semi"), study.raw, 25)
    cos = P.cosine_of_pairs(base, cut_lineage(inferred, "inferred"))
    out.append(base.join(cos, ["a", "b"]).select("a", "b", "z", "sim", F.col("raw").alias("score"),
                                                 F.lit("neighbour").alias("method")))
    stacked = out[0]
    for other in out[1:]:
        stacked = stacked.unionByName(other)
    return stacked.withColumn("score", F.round("score", 6))


SCORES = ",\n".join(
    [TEACHER]
    + [Q.fp(f"fp_{k}", "ptok", k) + ",\n" + Q.tanimoto_pairs(f"s_{k}", "prs", f"fp_{k}") for k in KINDS]
    + ["""dv AS (SELECT p_partkey AS id, [(p_size-avg(p_size) OVER ())/(stddev_pop(p_size) OVER ()+1e-8),
 (p_retailprice-avg(p_retailprice) OVER ())/(stddev_pop(p_retailprice) OVER ()+1e-8),
 (length(p_name)-avg(length(p_name)) OVER ())/(stddev_pop(length(p_name)) OVER ()+1e-8),
 (length(p_brand)-avg(length(p_brand)) OVER ())/(stddev_pop(length(p_brand)) OVER ()+1e-8)]::DOUBLE[] AS v FROM part),
us AS (SELECT a AS entity FROM prs UNION SELECT b FROM prs),
qfp AS MATERIALIZED (SELECT * FROM pfp WHERE id IN (SELECT entity FROM us)),
rfp AS MATERIALIZED (SELECT * FROM pfp WHERE id IN (SELECT entity FROM ents WHERE split=0))""",
       Q.tanimoto_all("nt", "qfp", "rfp"),
       """nn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rk FROM nt) WHERE rk <= 25),
nw AS (SELECT a, sum(sim) AS w FROM nn GROUP BY 1),
inf AS MATERIALIZED (SELECT nn.a AS entity, target, sum(sim*value)/any_value(w) AS value FROM nn JOIN raw ON raw.entity=b JOIN nw ON nw.a=nn.a GROUP BY 1,2)""",
       Q.cosine("ncs", "prs", "inf")]
    + ["sc AS MATERIALIZED (" + " UNION ALL ".join(
        [f"SELECT '{k}' AS method, a, b, z, tea.sim, round(s.sim,6) AS score FROM tea JOIN s_{k} s USING (a, b)" for k in KINDS]
        + ["SELECT 'neighbour', a, b, z, sim, round(ncs.raw,6) FROM tea JOIN ncs USING (a, b)",
           "SELECT 'descriptors', a, b, z, sim, round(list_cosine_similarity(x.v, y.v),6) FROM tea JOIN dv x ON x.id=a JOIN dv y ON y.id=b"]) + ")",
       """rg AS (SELECT *, 'overall' AS regime FROM sc UNION ALL SELECT *, 'scaffold_hop' FROM sc WHERE sim < 0.35 UNION ALL SELECT *, 'cliff' FROM sc WHERE sim > 0.60),
rr AS (SELECT *, rank() OVER (PARTITION BY method, regime ORDER BY score) + (count(*) OVER (PARTITION BY method, regime, score)-1)/2.0::DOUBLE AS rs,
 rank() OVER (PARTITION BY method, regime ORDER BY z) + (count(*) OVER (PARTITION BY method, regime, z)-1)/2.0::DOUBLE AS rz FROM rg)""",
       f"""mt AS (SELECT method, regime, count(*) AS n, covar_pop(rs,rz)/nullif(stddev_pop(rs)*stddev_pop(rz),0) AS spearman,
 (sum(rs) FILTER (z >= {RELATED}) - count(*) FILTER (z >= {RELATED})*(count(*) FILTER (z >= {RELATED})+1)/2.0::DOUBLE)
 /nullif(count(*) FILTER (z >= {RELATED})::DOUBLE*count(*) FILTER (z < {RELATED}),0) AS auc FROM rr GROUP BY 1,2)"""])


WHOLE_SCORES = SCORES.replace(TEACHER, WHOLE)


@query("regime_metrics", f"WITH {WHOLE_SCORES} SELECT regime, n, CASE WHEN n >= 100 THEN round(spearman,4) END AS spearman, CASE WHEN n >= 100 THEN round(auc,4) END AS auc FROM mt WHERE method='ngram2'")
def _(t):
    pairs = Study(t).pairs(ANY).withColumn("method", F.lit("ngram2"))
    return M.regime_metrics(pairs, "method", "sim", "z", "sim", RELATED).select(
        "regime", "n", F.round("spearman", 4).alias("spearman"), F.round("auc", 4).alias("auc"))


BAKE = [f"{r}_{m}" for r in ("overall", "scaffold_hop", "cliff") for m in ("spearman", "auc")]


@query("method_bakeoff", f"WITH {SCORES}, w AS (SELECT method, regime||'_spearman' AS c, CASE WHEN n >= 100 THEN spearman END AS v FROM mt UNION ALL SELECT method, regime||'_auc', CASE WHEN n >= 100 THEN auc END FROM mt) SELECT method, "
       + ", ".join(f"round(max(v) FILTER (c='{c}'),4) AS {c}" for c in BAKE) + " FROM w GROUP BY 1")
def _(t):
    from likeness.sources.results import metrics_wide

    study = Study(t)
    scores = cut_lineage(method_scores(study, study.pairs()), "scores")
    long = M.regime_metrics(scores, "method", "score", "z", "sim", RELATED).unpivot(
        ["method", "regime"], ["spearman", "auc"], "metric", "value")
    wide = metrics_wide(long.withColumn("name", F.concat_ws("_", "regime", "metric")), "name", BAKE)
    return wide.select("method", *[F.round(c, 4).alias(c) for c in BAKE])
