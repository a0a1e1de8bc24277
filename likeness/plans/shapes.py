"""Clouds of events per user: descriptors, distances and transport costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.operators import clouds as C
from likeness.operators import transport as T
from likeness.operators.metrics import spearman
from likeness.operators.ordering import dense_index, value_ranks
from likeness.plans.registry import query
from likeness.session import cut_lineage

TYPES = ["click", "view", "purchase", "signup"]
ALL_TYPES = [*TYPES, "error"]  # the last has no cost against the others, so clouds leave it out
SETS, ALL_SETS = 2 * len(TYPES), 2 * len(ALL_TYPES)  # each type before and after noon
# Mismatch of types: how far apart they lie on the way from looking to joining, as a
# share of the whole way (view, click, purchase, signup).
STAGE = {"view": 0, "click": 1, "purchase": 2, "signup": 3}
TYPE_COST = [[abs(STAGE[a] - STAGE[b]) / (len(STAGE) - 1) for b in TYPES] for a in TYPES]
EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def event_points(t):
    """(entity, id, type, s, x, y): hours since the epoch and the event's value."""
    kind = F.when(F.col("event_type") == ALL_TYPES[0], 0)
    for i, name in enumerate(ALL_TYPES[1:], 1):
        kind = kind.when(F.col("event_type") == name, i)
    hours = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / 3.6e9
    return t.events.select(
        F.col("user_id").alias("entity"), F.col("event_id").alias("id"), F.col("event_type").alias("type"),
        (kind * 2 + F.when(F.hour("ts") >= 12, 1).otherwise(0)).alias("s"),
        hours.alias("x"), F.col("value").alias("y"))


PTS = """pts AS (SELECT user_id AS entity, event_id AS id, event_type AS type,
 (CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END)*2 + (hour(ts) >= 12)::INT AS s,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))/3.6e9 AS x, value AS y FROM events)"""
KNOWN = f"{PTS}, kn AS (SELECT * FROM pts WHERE s < {SETS})"


@query("cloud_descriptors", f"""WITH {PTS}, n AS (SELECT entity, """ + ", ".join(f"count(*) FILTER (type='{v}') AS n_{v}" for v in ALL_TYPES)
       + """, count(*) AS n FROM pts GROUP BY 1), d AS (SELECT a.entity, avg(abs(a.x-b.x)) AS mean, stddev_pop(abs(a.x-b.x)) AS std, max(abs(a.x-b.x)) AS highest
 FROM pts a JOIN pts b ON a.entity=b.entity AND a.id < b.id GROUP BY 1)
SELECT n.*, round(coalesce(mean,0),5) AS mean, round(coalesce(std,0),5) AS std, round(coalesce(highest,0),5) AS highest FROM n LEFT JOIN d USING (entity)""")
def _(t):
    d = C.cloud_descriptors(event_points(t), ALL_TYPES)
    return d.withColumns({c: F.round(c, 5) for c in ("mean", "std", "highest")})


def metric_points(t):
    """(entity, metric, s, x): the same sets on three lines, which are time, rank in time and value."""
    p = event_points(t)
    rank = value_ranks(p, ["entity"], "x").select("entity", "x", F.col("before").cast("double").alias("r"))
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("x")) for m, c in (("time", "x"), ("rank", "r"), ("value", "y"))])
    return p.join(rank, ["entity", "x"]).select("entity", "s", lines.alias("lines")).select("entity", "s", F.inline("lines"))


@query("feature_distance", f"""WITH {PTS}, q AS (SELECT *, (rank() OVER (PARTITION BY entity ORDER BY x) - 1)::DOUBLE AS r FROM pts),
m AS (SELECT entity, s, 'time' AS metric, x AS v FROM q UNION ALL SELECT entity, s, 'rank', r FROM q UNION ALL SELECT entity, s, 'value', y FROM q)
SELECT a.entity, a.metric, a.s::BIGINT AS i, b.s::BIGINT AS j, round(avg(abs(a.v-b.v))+1e-9,5) AS distance FROM m a JOIN m b
 ON a.entity=b.entity AND a.metric=b.metric AND a.s < b.s GROUP BY 1,2,3,4""")
def _(t):
    lines = metric_points(t).withColumn("entity", F.struct("entity", "metric")).drop("metric")
    return C.set_distances(lines, ALL_SETS).select(
        "entity.*", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
        F.round(F.col("distance") + 1e-9, 5).alias("distance"))  # off the exact ties of rounding


def event_clouds(t, points=None):
    points = event_points(t) if points is None else points
    return C.build_clouds(points.filter(F.col("s") < SETS), SETS, lambda s: F.floor(s / 2).cast("int"))


@query("build_clouds", f"""WITH {KNOWN}, o AS (SELECT entity, s, count(*) AS c FROM kn GROUP BY 1,2),
d AS (SELECT a.entity, a.s AS i, b.s AS j, avg(abs(a.x-b.x)) AS d FROM kn a JOIN kn b ON a.entity=b.entity AND a.s<>b.s GROUP BY 1,2,3),
ds AS (SELECT entity, sum(d) AS total FROM d GROUP BY 1)
SELECT o.entity, count(*) AS points, string_agg((s//2)::VARCHAR, ',' ORDER BY s) AS types, round(1.0::DOUBLE/count(*),6) AS weight, round(coalesce(any_value(total),0.0),4) AS total
FROM o LEFT JOIN ds USING (entity) GROUP BY 1""")
def _(t):
    clouds = event_clouds(t)
    add = lambda acc, x: acc + x
    return clouds.select(
        "entity", F.size("types").cast("long").alias("points"), F.array_join("types", ",").alias("types"),
        F.round(F.element_at("weights", 1), 6).alias("weight"),
        F.round(F.aggregate(F.flatten("dist"), F.lit(0.0), add), 4).alias("total"))


@query("usr_moments", f"""WITH {PTS}, c AS (SELECT entity, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY 1),
d1 AS (SELECT p.*, cx, cy, round(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)),9) AS d FROM pts p JOIN c USING (entity)),
n AS (SELECT DISTINCT entity, first_value([x,y]) OVER (PARTITION BY entity ORDER BY d, id) AS cst, first_value([x,y]) OVER (PARTITION BY entity ORDER BY d DESC, id) AS fct FROM d1),
d2 AS (SELECT p.*, fct, round(sqrt((x-fct[1])*(x-fct[1])+(y-fct[2])*(y-fct[2])),9) AS d FROM pts p JOIN n USING (entity)),
f AS (SELECT DISTINCT entity, first_value([x,y]) OVER (PARTITION BY entity ORDER BY d DESC, id) AS ftf FROM d2),
l AS (SELECT p.entity, p.type, r.ref, sqrt((x-r.pt[1])*(x-r.pt[1])+(y-r.pt[2])*(y-r.pt[2])) AS d FROM pts p JOIN c USING (entity) JOIN n USING (entity) JOIN f USING (entity),
 LATERAL (SELECT unnest(['ctd','cst','fct','ftf']) AS ref, unnest([[cx,cy],cst,fct,ftf]) AS pt) r),
s AS (SELECT entity, 'all' AS subset, ref, d FROM l UNION ALL SELECT entity, type, ref, d FROM l),
m AS (SELECT *, avg(d) OVER (PARTITION BY entity, subset, ref) AS mu FROM s)
SELECT entity, subset, ref, round(any_value(mu),5) AS mean, round(stddev_pop(d),5) AS std, round(CASE WHEN stddev_pop(d) > 1e-9 THEN avg((d-mu)**3)/power(stddev_pop(d),3) ELSE 0.0 END,4) AS skew FROM m GROUP BY 1,2,3""")
def _(t):
    m = C.shape_moments(event_points(t))
    return m.select("entity", "subset", "ref", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"),
                    F.round("skew", 4).alias("skew"))


def ring(clouds):
    """Each entity with the next one in hash order: as many pairs as entities."""
    indexed = cut_lineage(dense_index(clouds.select("entity"), "entity", "ring", index="idx", total="n"), "ring")
    after = indexed.select(F.pmod(F.col("idx") - 1, F.col("n")).alias("idx"), F.col("entity").alias("b"))
    return indexed.select("idx", F.col("entity").alias("a")).join(after, "idx").select("a", "b")


@query("fgw_pairs")
def _(t):
    clouds = cut_lineage(event_clouds(t), "clouds")
    return T.fgw_costs(ring(clouds), clouds, TYPE_COST)


@query("fgw_plan")
def _(t):
    clouds = cut_lineage(event_clouds(t), "clouds")
    return T.fgw_plans(ring(clouds), clouds, TYPE_COST)


@query("fgw_plan_marginals", f"""WITH {KNOWN}, o AS (SELECT DISTINCT entity, s FROM kn),
p AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY s) - 1 AS position, round(1.0::DOUBLE / count(*) OVER (PARTITION BY entity), 9) AS mass FROM o)
SELECT side, entity, position, mass FROM p, (VALUES ('a'), ('b')) v(side)""")
def _(t):
    """What each point sends (side a) and receives (side b): every entity is once on either side."""
    clouds = cut_lineage(event_clouds(t), "clouds")
    moved = T.fgw_plans(ring(clouds), clouds, TYPE_COST)
    ends = F.inline(F.array(
        F.struct(F.lit("a").alias("side"), F.col("a").alias("entity"), F.col("i").cast("long").alias("position"), "mass"),
        F.struct(F.lit("b").alias("side"), F.col("b").alias("entity"), F.col("j").cast("long").alias("position"), "mass")))
    return moved.select(ends).groupBy("side", "entity", "position").agg(F.round(F.sum("mass"), 9).alias("mass"))


@query("param_sweep")
def _(t):
    """Spearman of cost against the gap in mean value, by alpha and by metric."""
    level = event_points(t).groupBy("entity").agg(F.avg("y").alias("level"))
    out = None
    lines = cut_lineage(metric_points(t), "lines")
    for name in ("time", "rank", "value"):
        points = lines.filter(F.col("metric") == name).drop("metric")
        clouds = cut_lineage(event_clouds(t, points), f"clouds-{name}")
        alphas = F.array(*[F.lit(a) for a in ((0.0, 0.25, 0.5, 0.75, 1.0) if name == "time" else (0.5,))])
        pairs = ring(clouds).select("a", "b", F.explode(alphas).alias("alpha"), F.lit(name).alias("metric"))
        costs = T.fgw_costs(pairs, clouds, TYPE_COST)
        out = costs if out is None else out.unionByName(costs)
    scored = (out.withColumn("cost", F.round("cost", 9))
              .join(level.toDF("a", "la"), "a").join(level.toDF("b", "lb"), "b")
              .withColumn("gap", F.abs(F.col("la") - F.col("lb"))))
    return spearman(cut_lineage(scored, "sweep"), ["metric", "alpha"], "cost", "gap")
