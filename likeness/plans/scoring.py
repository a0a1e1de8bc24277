"""Metrics, result tables and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.operators import boards as B
from likeness.operators import bootstrap as BS
from likeness.operators import metrics as M
from likeness.operators.ordering import quantile, value_ranks
from likeness.operators.sampling import random_pairs
from likeness.functions import vectors as V
from likeness.plans import sqlparts as Q
from likeness.plans.registry import query
from likeness.session import cut_lineage, scratch_path
from likeness.sources import results as R

r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


GUESSES = ["qty", "lines", "price", "const"]


def predictions(t):
    """(task, method, id, y, pred): order totals guessed from the order's lines."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.count("*").cast("double").alias("lines"),
        F.sum("l_extendedprice").alias("price"))
    guesses = F.array(*[F.struct(F.lit(m).alias("method"), F.round(c, 2).alias("pred")) for m, c in (
        ("qty", F.col("qty")), ("lines", F.col("lines")), ("price", F.col("price")), ("const", F.lit(1.0)))])
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"),
        F.inline(guesses))


PRED = """ln AS (SELECT l_orderkey, sum(l_quantity) AS qty, count(*)::DOUBLE AS lines, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1),
pr AS MATERIALIZED (SELECT o_orderpriority AS task, o_orderkey AS id, o_totalprice AS y, method, round(pred,2) AS pred FROM orders JOIN ln ON l_orderkey=o_orderkey,
 LATERAL (SELECT unnest(['qty','lines','price','const']) AS method, unnest([qty, lines, price, 1.0]) AS pred)),
rk AS (SELECT *, rank() OVER (PARTITION BY task, method ORDER BY y) + (count(*) OVER (PARTITION BY task, method, y) - 1)/2.0::DOUBLE AS ry,
 rank() OVER (PARTITION BY task, method ORDER BY pred) + (count(*) OVER (PARTITION BY task, method, pred) - 1)/2.0::DOUBLE AS rp FROM pr)"""

CORR = "covar_pop({0},{1})/nullif(stddev_pop({0})*stddev_pop({1}),0)"


@query("average_ranks", f"WITH {PRED} SELECT DISTINCT task, method, pred, rp AS avg_rank FROM rk")
def _(t):
    return value_ranks(predictions(t), ["task", "method"], "pred").select("task", "method", "pred", "avg_rank")


@query("spearman", f"WITH {PRED} SELECT task, method, round({CORR.format('ry', 'rp')},6) AS spearman FROM rk GROUP BY 1,2")
def _(t):
    return M.spearman(predictions(t), ["task", "method"], "y", "pred").select("task", "method", *r6("spearman"))


@query("pearson", f"WITH {PRED} SELECT task, method, round({CORR.format('y', 'pred')},6) AS pearson FROM pr GROUP BY 1,2")
def _(t):
    return predictions(t).groupBy("task", "method").agg(F.round(M.linear_correlation("y", "pred"), 6).alias("pearson"))


@query("mae_rmse", f"WITH {PRED} SELECT task, method, round(avg(abs(y-pred)),5) AS mae, round(sqrt(avg((y-pred)*(y-pred))),5) AS rmse, count(*) AS n FROM pr GROUP BY 1,2")
def _(t):
    return M.errors(predictions(t), ["task", "method"], "y", "pred").select(
        "task", "method", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), "n")


@query("roc_auc", """WITH d AS (SELECT lang, n_chars, quality=1 AS pos FROM documents JOIN labels USING (doc_id)),
r AS (SELECT lang, pos, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars)-1)/2.0::DOUBLE AS rk FROM d),
s AS (SELECT lang, sum(rk) FILTER (pos) AS sr, count(*) FILTER (pos)::DOUBLE AS p, count(*) FILTER (NOT pos)::DOUBLE AS q FROM r GROUP BY 1)
SELECT lang, round((sr - p*(p+1)/2)/nullif(p*q,0),6) AS auc FROM s""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id").withColumn("pos", F.col("quality") == 1)
    return M.roc_auc(rows, ["lang"], "n_chars", "pos").select("lang", *r6("auc"))


TOP = """qt AS (SELECT task, method, quantile_cont(y, 0.75) AS edge FROM pr GROUP BY 1,2),
ac AS (SELECT rk.*, y >= edge AS active, row_number() OVER (PARTITION BY task, method ORDER BY pred DESC, md5(concat_ws('|', id, 'top')), id) AS top,
 greatest(1, round_even(count(*) OVER (PARTITION BY task, method)*0.1,0)::BIGINT) AS k FROM rk JOIN qt USING (task, method)),
tm AS (SELECT task, method, count(*) AS n, count(*) >= 5 AND min(pred) < max(pred) AS ok,
 round(covar_pop(ry,rp)/nullif(stddev_pop(ry)*stddev_pop(rp),0),6) AS spearman, round(covar_pop(y,pred)/nullif(stddev_pop(y)*stddev_pop(pred),0),6) AS pearson,
 round(avg(abs(y-pred)),5) AS mae, round(sqrt(avg((y-pred)*(y-pred))),5) AS rmse,
 round((sum(rp) FILTER (active) - count(*) FILTER (active)*(count(*) FILTER (active)+1)/2.0::DOUBLE)
  /nullif(count(*) FILTER (active)::DOUBLE*count(*) FILTER (NOT active),0),6) AS roc_auc,
 round(count(*) FILTER (active AND top <= k)::DOUBLE/count(*) FILTER (top <= k),6) AS prec10,
 round(count(*) FILTER (active AND top <= k)::DOUBLE/nullif(count(*) FILTER (active),0),6) AS rec10 FROM ac GROUP BY 1,2)"""


@query("precision_recall_at_k", f"WITH {PRED}, {TOP} SELECT task, method, prec10, rec10 FROM tm")
def _(t):
    keys = ["task", "method"]
    p = predictions(t)
    flagged = p.join(quantile(p, keys, "y", 0.75, "edge"), keys).withColumn("active", F.col("y") >= F.col("edge"))
    return M.top_precision_recall(flagged, keys, "pred", "id", "active").select(*keys, *r6("prec10", "rec10"))


@query("task_metrics", f"""WITH {PRED}, {TOP} SELECT task, method, n, CASE WHEN ok THEN spearman END AS spearman, CASE WHEN ok THEN pearson END AS pearson,
 CASE WHEN ok THEN mae END AS mae, CASE WHEN ok THEN rmse END AS rmse, CASE WHEN ok THEN roc_auc END AS roc_auc,
 CASE WHEN ok AND roc_auc IS NOT NULL THEN prec10 END AS prec10, CASE WHEN ok AND roc_auc IS NOT NULL THEN rec10 END AS rec10 FROM tm""")
def _(t):
    rows = cut_lineage(predictions(t), "predictions")  # read once per metric
    m = M.task_metrics(rows, ["task", "method"], "id", "y", "pred")
    return m.select("task", "method", "n", *r6("spearman", "pearson", "roc_auc", "prec10", "rec10"),
                    F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"))


@query("rae", f"WITH {PRED}, mn AS (SELECT task, method, avg(y) AS m FROM pr GROUP BY 1,2) SELECT task, method, round(avg(abs(y-pred))/avg(abs(y-m)),6) AS rae FROM pr JOIN mn USING (task, method) GROUP BY 1,2")
def _(t):
    return M.relative_error(predictions(t), ["task", "method"], "y", "pred").select("task", "method", *r6("rae"))


REPLICATES = 1000
_W = "CASE " + " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(BS.POISSON)) + f" ELSE {len(BS.POISSON)} END"
BOOT = f"""bd AS (SELECT DISTINCT task, id, y FROM pr),
bw AS (SELECT task, id, y, blk*8 + j AS rep, ('0x'||substr(h, 1 + 4*j, 4))::INT/65536.0::DOUBLE AS u
 FROM (SELECT *, md5(concat_ws('|', task, id, blk, 'boot')) AS h FROM bd, range({REPLICATES // 8}) b(blk)), range(8) r(j)),
w AS MATERIALIZED (SELECT task, id, y, rep::INT AS rep, ({_W})::UTINYINT AS w FROM bw WHERE u >= {BS.POISSON[0]!r}),
mn AS (SELECT task, rep, sum(w*y)/sum(w) AS m FROM w GROUP BY 1,2),
dn AS (SELECT task, rep, sum(w*abs(y-m)) AS den FROM w JOIN mn USING (task, rep) GROUP BY 1,2),
nm AS (SELECT task, method, rep, sum(w*abs(w.y-pred)) AS num FROM w JOIN pr USING (task, id) GROUP BY 1,2,3),
ra AS (SELECT task, method, num/nullif(den, 0) AS rae FROM nm JOIN dn USING (task, rep))"""


def bootstrapped(t):
    return BS.bootstrap_errors(predictions(t), ["task"], "method", "id", "y", "pred", REPLICATES, "boot")


@query("bootstrap_rae", f"WITH {PRED}, {BOOT} SELECT task, method, round(avg(rae),6) AS rae FROM ra GROUP BY 1,2")
def _(t):
    return bootstrapped(t).select("task", "method", *r6("rae"))


@query("bootstrap_rae_poisson", f"WITH {PRED}, {BOOT} SELECT task, method, round(avg(rae),6) AS rae, round(stddev_pop(rae),6) AS spread, count(rae) AS replicates FROM ra GROUP BY 1,2")
def _(t):
    return bootstrapped(t).select("task", "method", *r6("rae", "spread"), "replicates")


# --- ranks of pair distances --------------------------------------------------

PAIRS = f"""{Q.random_pairs('vp', 'embeddings', 'vec_id', 20, 'sar')},
pd AS (SELECT DISTINCT least(p.a,p.b) AS a, greatest(p.a,p.b) AS b FROM vp p),
dd AS MATERIALIZED (SELECT a, b, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]),6) AS near,
 round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: abs(z[1]::DOUBLE-z[2]::DOUBLE))),6) AS city,
 abs(x.label-y.label)::DOUBLE AS dy FROM pd JOIN embeddings x ON x.vec_id=a JOIN embeddings y ON y.vec_id=b),
r1 AS (SELECT *, (row_number() OVER (ORDER BY near, md5(concat_ws('|',a,b,'rank01')), a, b) - 1)/(count(*) OVER () - 1)::DOUBLE AS near01,
 (row_number() OVER (ORDER BY city, md5(concat_ws('|',a,b,'rank01')), a, b) - 1)/(count(*) OVER () - 1)::DOUBLE AS city01 FROM dd)"""


def pair_distances(t):
    drawn = random_pairs(t.embeddings, "vec_id", 20, "sar").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    v = t.embeddings.select("vec_id", "embedding", "label")
    joined = drawn.join(v.toDF("a", "va", "la"), "a").join(v.toDF("b", "vb", "lb"), "b")
    # As stored while they travel, in double precision where they have met.
    joined = joined.withColumns({c: V.as_double(c) for c in ("va", "vb")})
    city = V.total(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)))
    return joined.select("a", "b", F.round(V.euclidean(F.col("va"), F.col("vb")), 6).alias("near"),
                         F.round(city, 6).alias("city"), F.abs(F.col("la") - F.col("lb")).cast("double").alias("dy"),
                         F.lit("all").alias("task"))


def ranked_pairs(t):
    pairs = cut_lineage(pair_distances(t), "pairs")  # an order reads its rows several times
    once = cut_lineage(M.ordinal_rank01(pairs, ["task"], "near", ["a", "b"], "near01"), "near")
    return M.ordinal_rank01(once, ["task"], "city", ["a", "b"], "city01")


@query("rank01", f"WITH {PAIRS} SELECT a, b, round(near01,6) AS near01, round(city01,6) AS city01 FROM r1")
def _(t):
    return ranked_pairs(t).select("a", "b", *r6("near01", "city01"))


@query("masked_argmax", f"""WITH {PAIRS}, q AS (SELECT quantile_cont(dy, 0.4) AS q40 FROM r1),
h AS (SELECT 'hop' AS kind, a, b, round(city01-near01,6) AS score FROM r1, q WHERE dy < q40 ORDER BY round(city01-near01,6) DESC, a, b LIMIT 1),
c AS (SELECT 'cliff' AS kind, a, b, dy AS score FROM r1 WHERE city01 < 0.1 ORDER BY dy DESC, a, b LIMIT 1)
SELECT * FROM h UNION ALL SELECT * FROM c""")
def _(t):
    pairs = cut_lineage(ranked_pairs(t), "ranked")
    q40 = quantile(pairs, ["task"], "dy", 0.4).select("quantile").scalar()

    def first(rows, kind, score):
        best = F.max_by(F.struct("a", "b", score.alias("score")), F.struct(score, -F.col("a"), -F.col("b")))
        return rows.agg(best.alias("p")).select(F.lit(kind).alias("kind"), "p.a", "p.b", "p.score").dropna()

    hop = first(pairs.filter(F.col("dy") < q40), "hop", F.round(F.col("city01") - F.col("near01"), 6))
    return hop.unionByName(first(pairs.filter("city01 < 0.1"), "cliff", F.col("dy")))


@query("neighbour_continuity", f"""WITH {PAIRS}, rr AS (SELECT rank() OVER (ORDER BY near)+(count(*) OVER (PARTITION BY near)-1)/2.0::DOUBLE AS x,
 rank() OVER (ORDER BY city)+(count(*) OVER (PARTITION BY city)-1)/2.0::DOUBLE AS z, rank() OVER (ORDER BY dy)+(count(*) OVER (PARTITION BY dy)-1)/2.0::DOUBLE AS y FROM dd)
SELECT round(corr(x,y),6) AS near_rho, round(corr(z,y),6) AS city_rho, count(*) AS n FROM rr""")
def _(t):
    pairs = cut_lineage(pair_distances(t), "pairs")
    rho = lambda c: M.spearman(pairs, ["task"], c, "dy", f"{c}_rho")
    n = pairs.groupBy("task").agg(F.count("*").alias("n"))
    return rho("near").join(rho("city"), "task").join(n, "task").select(*r6("near_rho", "city_rho"), "n")


# --- result tables ------------------------------------------------------------

METHODS = ["qty", "retail", "tax", "flat"]


def metrics_long(t, where=None):
    """(suite, endpoint, method, metric, value) of four price guesses.

    The last method is missing for one suite, as a costly method would be.
    """
    lines = t.lineitem if where is None else t.lineitem.filter(where)
    joined = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey"))
    guesses = F.array(*[F.struct(F.lit(m).alias("method"), c.alias("pred")) for m, c in (
        ("qty", F.col("l_quantity") * 1500.0), ("retail", F.col("l_quantity") * F.col("p_retailprice")),
        ("tax", F.col("l_quantity") * (1000.0 + F.col("l_tax") * 5000.0)),
        ("flat", F.when(F.col("o_orderstatus") != "P", F.lit(40000.0) + F.col("l_linenumber"))))])
    rows = joined.select(F.col("o_orderstatus").alias("suite"), F.col("o_orderpriority").alias("endpoint"),
                         F.col("l_extendedprice").alias("y"), F.inline(guesses)).dropna(subset=["pred"])
    gap = F.col("y") - F.col("pred")
    agg = rows.groupBy("suite", "endpoint", "method").agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        M.linear_correlation("y", "pred").alias("pearson"))
    return agg.unpivot(["suite", "endpoint", "method"], ["mae", "rmse", "pearson"], "metric", "value")


def mlong_sql(name="ml", where="true"):
    return f"""{name}_p AS (SELECT o_orderstatus AS suite, o_orderpriority AS endpoint, l_extendedprice AS y, method, pred
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey, LATERAL (SELECT unnest(['qty','retail','tax','flat']) AS method,
 unnest([l_quantity*1500.0, l_quantity*p_retailprice, l_quantity*(1000.0+l_tax*5000.0), CASE WHEN o_orderstatus<>'P' THEN 40000.0+l_linenumber END]::DOUBLE[]) AS pred)
 WHERE pred IS NOT NULL AND {where}),
{name}_a AS (SELECT suite, endpoint, method, avg(abs(y-pred)) AS mae, sqrt(avg((y-pred)*(y-pred))) AS rmse,
 covar_pop(y,pred)/nullif(stddev_pop(y)*stddev_pop(pred),0) AS pearson FROM {name}_p GROUP BY 1,2,3),
{name} AS MATERIALIZED (SELECT suite, endpoint, method, 'mae' AS metric, mae AS value FROM {name}_a UNION ALL SELECT suite, endpoint, method, 'rmse', rmse FROM {name}_a
 UNION ALL SELECT suite, endpoint, method, 'pearson', pearson FROM {name}_a)"""


ML = mlong_sql()


@query("sink_metrics_json", f"WITH {ML} SELECT suite, endpoint, method, metric, round(value,5) AS value FROM ml")
def _(t):
    path = scratch_path(t.spark, "metrics-json")
    R.write_metrics_json(metrics_long(t), path)
    return R.read_metrics_json(t.spark, path).withColumn("value", F.round("value", 5))


WIDE = [f"{s}_{m}" for s in ("F", "O", "P") for m in ("mae", "rmse", "pearson")]


@query("sink_metrics_wide", f"WITH {ML}, g AS (SELECT method, suite||'_'||metric AS c, avg(value) AS v FROM ml GROUP BY 1,2) SELECT method, "
       + ", ".join(f"round(max(v) FILTER (c='{w}'),5) AS {w}" for w in WIDE) + " FROM g GROUP BY 1")
def _(t):
    per = (metrics_long(t).groupBy("method", F.concat_ws("_", "suite", "metric").alias("name")).agg(F.avg("value").alias("value")))
    path = scratch_path(t.spark, "metrics-csv")
    R.metrics_wide(per, "name", WIDE).write.csv(path, header=True)
    schema = "method string, " + ", ".join(f"{w} double" for w in WIDE)
    return t.spark.read.schema(schema).csv(path, header=True).select(
        "method", *[F.round(w, 5).alias(w) for w in WIDE])


@query("predictions_wide", f"WITH {PRED} SELECT task, id, y, " + ", ".join(
    f"max(pred) FILTER (method='{m}') AS {m}" for m in GUESSES) + " FROM pr GROUP BY 1,2,3")
def _(t):
    return R.predictions_wide(predictions(t), ["task", "id", "y"], GUESSES)


@query("resume_pending", """SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS
 (SELECT 1 FROM orders d WHERE d.o_orderstatus='F' AND d.o_custkey=o.o_custkey AND d.o_orderpriority=o.o_orderpriority)""")
def _(t):
    keys = ["o_custkey", "o_orderpriority"]
    return R.pending(t.orders.select(*keys).distinct(), t.orders.filter("o_orderstatus = 'F'").select(*keys), keys)


OPEN_ONLY = mlong_sql("mo", "l_linestatus = 'O'")
SHUT_ONLY = mlong_sql("mf", "l_linestatus = 'F'")


@query("merge_results", f"""WITH {OPEN_ONLY}, {SHUT_ONLY}, up AS (SELECT * FROM mf WHERE method='retail')
SELECT suite, endpoint, method, metric, round(value,5) AS value FROM (SELECT * FROM mo WHERE method<>'retail' UNION ALL SELECT * FROM up)""")
def _(t):
    old = metrics_long(t, "l_linestatus = 'O'")
    new = metrics_long(t, "l_linestatus = 'F'").filter("method = 'retail'")
    return R.merge_results(old, new, ["method"]).withColumn("value", F.round("value", 5))


@query("paired_delta", f"WITH {OPEN_ONLY}, {SHUT_ONLY} SELECT method, round(avg(mf.value-mo.value),5) AS delta, count(*) AS cells FROM mo JOIN mf USING (suite, endpoint, method, metric) WHERE metric='mae' GROUP BY 1")
def _(t):
    one = lambda w: metrics_long(t, w).filter("metric = 'mae'")
    return B.paired_delta(one("l_linestatus = 'O'"), one("l_linestatus = 'F'"), ["suite", "endpoint"]).withColumn(
        "delta", F.round("delta", 5))


@query("nan_mean", f"WITH {ML}, g AS (SELECT method, CASE WHEN value < 0.0 THEN NULL ELSE value END AS v FROM ml WHERE metric='pearson') SELECT method, round(avg(v),6) AS mean FROM g WHERE v IS NOT NULL GROUP BY 1")
def _(t):
    gaps = metrics_long(t).filter("metric = 'pearson'").withColumn(
        "value", F.when(F.col("value") < 0.0, float("nan")).otherwise(F.col("value")))
    return B.finite_mean(gaps, ["method"], "value", "mean").select("method", *r6("mean"))


@query("head_to_head", f"""WITH {ML}, p AS (SELECT * FROM ml WHERE metric='pearson'), b AS (SELECT suite, endpoint, value AS base FROM p WHERE method='tax')
SELECT method, count(*) FILTER (value > base) AS wins, count(*) AS total, round(avg(value-base),6) AS delta FROM p JOIN b USING (suite, endpoint) WHERE method<>'tax' GROUP BY 1""")
def _(t):
    return B.head_to_head(metrics_long(t).filter("metric = 'pearson'"), "tax", ["suite", "endpoint"]).withColumn(
        "delta", F.round("delta", 6))


@query("best_method_per_row", f"WITH {ML} SELECT suite, endpoint, method, round(value,6) AS value, value = max(value) OVER (PARTITION BY suite, endpoint) AS best FROM ml WHERE metric='pearson'")
def _(t):
    m = metrics_long(t).filter("metric = 'pearson'")
    return B.best_method(m, ["suite", "endpoint"]).select("suite", "endpoint", "method", *r6("value"), "best")


@query("ordered_panel", f"""WITH {ML}, p AS (SELECT * FROM ml WHERE metric='mae') SELECT p.suite, p.endpoint, p.method, round(p.value,5) AS value,
 row_number() OVER (PARTITION BY p.suite, p.endpoint ORDER BY p.value, p.method) AS place, round(b.value,5) AS reference
 FROM p LEFT JOIN p b ON b.suite=p.suite AND b.endpoint=p.endpoint AND b.method='retail'""")
def _(t):
    m = metrics_long(t).filter("metric = 'mae'")
    return B.ordered_panel(m, "retail", ["suite", "endpoint"]).select(
        "suite", "endpoint", "method", F.round("value", 5).alias("value"), F.col("place").cast("long").alias("place"),
        F.round("reference", 5).alias("reference"))


@query("suite_table", f"WITH {ML}, p AS (SELECT * FROM ml WHERE metric='pearson'), w AS (SELECT suite, endpoint, method, value FROM p UNION ALL SELECT 'mean','mean', method, avg(value) FROM p GROUP BY method) SELECT suite, endpoint, "
       + ", ".join(f"round(max(value) FILTER (method='{m}'),6) AS {m}" for m in METHODS) + " FROM w GROUP BY 1,2")
def _(t):
    m = metrics_long(t).filter("metric = 'pearson'")
    return B.suite_table(m, ["suite", "endpoint"], METHODS).select("suite", "endpoint", *r6(*METHODS))


# --- boards -------------------------------------------------------------------


def boards(t):
    return t.customer.select(F.col("c_mktsegment").alias("endpoint"), F.col("c_acctbal").alias("value"))


def entrants(t):
    """Every supplier enters the board of every market segment."""
    segments = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    per = t.supplier.select(F.col("s_suppkey").alias("model"), "s_acctbal", F.explode(segments).alias("endpoint"))
    return per.select("model", "endpoint", (F.col("s_acctbal") * (1 + F.length("endpoint") / 100.0)).alias("value"))


ENTR = """bd AS (SELECT c_mktsegment AS endpoint, c_acctbal AS value FROM customer),
en AS (SELECT s_suppkey AS model, endpoint, s_acctbal*(1+length(endpoint)/100.0::DOUBLE) AS value FROM supplier,
 LATERAL (SELECT unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) AS endpoint)),
rb AS (SELECT model, endpoint, value, (SELECT count(*) FROM bd WHERE bd.endpoint=en.endpoint AND bd.value < en.value) AS below,
 (SELECT count(*) FROM bd WHERE bd.endpoint=en.endpoint) AS finalists FROM en)"""


@query("rank_against_board", f"WITH {ENTR} SELECT model, endpoint, round(value,6) AS value, below+1 AS rank, finalists, round(100.0*below/finalists,6) AS percentile FROM rb")
def _(t):
    return B.rank_against_board(entrants(t), boards(t), ["endpoint"]).withColumns(
        {c: F.round(c, 6) for c in ("value", "percentile")})


@query("board_summary", "SELECT c_mktsegment AS endpoint, min(c_acctbal) AS winner, max(c_acctbal) AS last, count(*) AS entrants, round(median(c_acctbal),6) AS median FROM customer GROUP BY 1")
def _(t):
    return B.board_summary(boards(t), ["endpoint"]).withColumn("median", F.round("median", 6))


@query("macro_average", f"WITH {ENTR} SELECT model, round(avg(value),6) AS value FROM en GROUP BY 1")
def _(t):
    return B.macro_average(entrants(t), "model", "value").withColumn("value", F.round("value", 6))


@query("placement_table", f"""WITH {ENTR}, ma AS (SELECT model, 'macro' AS endpoint, avg(value) AS value FROM en GROUP BY 1),
mr AS (SELECT model, endpoint, value, (SELECT count(*) FROM bd WHERE bd.value < ma.value) AS below, (SELECT count(*) FROM bd) AS finalists FROM ma),
al AS (SELECT * FROM rb UNION ALL SELECT * FROM mr), ends AS (SELECT model, min(below)+1 AS best, max(below)+1 AS worst FROM rb GROUP BY 1)
SELECT model, endpoint, round(value,4) AS value, below+1 AS rank, finalists, round(100.0*below/finalists,6) AS percentile, best, worst FROM al JOIN ends USING (model)""")
def _(t):
    table = B.placement_table(entrants(t), boards(t), boards(t), "model", "endpoint")
    return table.withColumn("value", F.round("value", 4)).withColumn("percentile", F.round("percentile", 6))
