"""Scans, sinks, task files and feature tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from likeness.functions import vectors as V
from likeness.operators import features as X
from likeness.plans import sqlparts as Q
from likeness.plans.base import SPARSE_CALLS, sparse_calls
from likeness.plans.likenesses import DESCRIPTORS, doc_descriptors, doc_prints, micro, vectors
from likeness.plans.registry import query
from likeness.session import scratch_path
from likeness.sources import matrices, tasks
from likeness.sources.tables import read_table


@query("scan_relational", """SELECT l_orderkey, l_partkey, l_quantity, p_brand FROM lineitem JOIN part ON l_partkey=p_partkey
WHERE l_discount < 0.05 AND l_returnflag IN ('A','R') AND p_size BETWEEN 10 AND 40""")
def _(t):
    lines = read_table(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"],
                       "l_discount < 0.05 AND l_returnflag IN ('A', 'R')")
    parts = read_table(t.spark, f"{t.folder}/part.parquet", ["p_partkey", "p_brand"], "p_size BETWEEN 10 AND 40")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


@query("scan_parquet_pruned", "SELECT l_partkey, l_suppkey FROM lineitem")
def _(t):
    return read_table(t.spark, f"{t.folder}/lineitem.parquet", ["l_partkey", "l_suppkey"])


@query("scan_csv_task", "SELECT p_partkey, p_retailprice AS last_target, p_size::BIGINT AS first_target FROM part")
def _(t):
    path = scratch_path(t.spark, "task-csv")
    t.part.write.csv(path, header=True)
    df = tasks.read_task_csv(t.spark, path)
    last, first = tasks.named_or_last(df, "potency"), tasks.first_numeric(df, ["p_partkey"])
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col(last).cast("double").alias("last_target"),
                     F.col(first).cast("long").alias("first_target"))


def order_split(t):
    side = F.when(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz"), "train").otherwise("test")
    return t.orders.select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("row_id"), side.alias("split"))


def written_split(t):
    path = scratch_path(t.spark, "split-json")
    tasks.write_split(order_split(t), path)
    return tasks.read_split(t.spark, path)


SIDE = "CASE WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN 'train' ELSE 'test' END"


@query("scan_split_json", f"SELECT o_orderpriority AS task, o_orderkey AS row_id, {SIDE} AS split FROM orders")
def _(t):
    return written_split(t)


@query("index_split", f"""WITH u AS (SELECT o_orderpriority AS task, o_orderkey AS row_id, o_totalprice AS y, {SIDE} AS split FROM orders WHERE o_orderstatus <> 'P'),
g AS (SELECT task, count(*) FILTER (split='train') < 30 OR count(*) FILTER (split='test') < 20 AS skipped FROM u GROUP BY 1)
SELECT task, row_id, y, split, skipped FROM u JOIN g USING (task)""")
def _(t):
    y = F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.col("o_totalprice").cast("string"))
    data = t.orders.select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("row_id"), y.alias("y"))
    return tasks.index_split(data, written_split(t)).select("task", "row_id", "y", "split", "skipped")


@query("sink_coo", f"WITH {SPARSE_CALLS} SELECT target, count(*) AS n, round(sum(value),6) AS total FROM calls GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "coo")
    matrices.write_coo(sparse_calls(t), path)
    cells, _entities, targets = matrices.read_coo(t.spark, path)
    return cells.join(targets, "target", "left_semi").groupBy("target").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("sink_features", f"""WITH {Q.doc_tokens()}, {Q.fp('fp', 'tok')}
SELECT tok.id AS doc_id, count(bit) AS n_bits, coalesce(sum(bit),0)::BIGINT AS checksum FROM tok LEFT JOIN fp USING (id) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "prints")
    matrices.write_features(doc_prints(t), path)
    back = t.spark.read.parquet(path)
    return back.select(F.col("id").alias("doc_id"), F.size("bits").cast("long").alias("n_bits"),
                       F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + b).alias("checksum"))


NUMBERS = ["chars", "words", "word_length", "capitals"]


@query("standardise", f"WITH {Q.doc_tokens()}, {DESCRIPTORS} SELECT doc_id, "
       + ", ".join(f"round(({c}-avg({c}) OVER ())/(stddev_pop({c}) OVER ()+1e-8),5) AS {c}" for c in NUMBERS) + " FROM descr")
def _(t):
    scaled = X.standardise(doc_descriptors(t).select("doc_id", *NUMBERS), NUMBERS)
    return scaled.select("doc_id", *[F.round(c, 5).alias(c) for c in NUMBERS])


@query("median_impute", """WITH l AS (SELECT event_id, event_type, CASE WHEN (props->>'$.k')::BIGINT % 10 <> 0 THEN value END AS v FROM events),
m AS (SELECT event_type, median(v) AS med FROM l GROUP BY 1)
SELECT event_id, event_type, round(coalesce(v, med),6) AS value FROM l JOIN m USING (event_type)""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    long = t.events.select("event_id", "event_type", F.when(k % 10 != 0, F.col("value")).alias("value"))
    return X.median_impute(long, "event_type", "value").select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("mean_pool", """WITH u AS (SELECT label, (vec_id % 3 <> 0)::INT AS m, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding,1) AS pos FROM embeddings)
SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(sum(x*m)/greatest(sum(m),1),6) AS value FROM u GROUP BY 1,2""")
def _(t):
    pooled = X.mean_pool(vectors(t), "label", "v", F.col("vec_id") % 3 != 0)
    return pooled.select(F.col("label").cast("long").alias("label"), F.posexplode("pooled").alias("pos", "value")).select(
        "label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("group_lists", """SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1""")
def _(t):
    # Nations of a region: a fixed dimension, so the lists are short.
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("members"))


@query("batch_map", """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x*((i-1)%5-2))),6) AS score FROM embeddings""")
def _(t):
    weights = np.arange(64) % 5 - 2.0

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(batch["v"].to_list()) if len(batch) else np.zeros((0, 64))
        return pd.DataFrame({"vec_id": batch["vec_id"], "score": x @ weights})

    return X.batch_map(vectors(t).select("vec_id", "v"), score, "vec_id long, score double").withColumn(
        "score", F.round("score", 6))


PICKS = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
st AS (SELECT 0 AS pick, (SELECT min(vec_id) FROM v) AS chosen, vec_id, e, round(list_distance(e, (SELECT arg_min(e, vec_id) FROM v)),6) AS d FROM v
 UNION ALL SELECT pick + 1, first_value(vec_id) OVER far, vec_id, e, least(d, round(list_distance(e, first_value(e) OVER far),6)) FROM st
 WHERE pick < {X.MAX_PICKS - 1} WINDOW far AS (ORDER BY d DESC, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
picks AS (SELECT DISTINCT pick, chosen FROM st)"""


@query("maxmin_pick", f"WITH RECURSIVE {PICKS} SELECT pick, chosen AS vec_id FROM picks")
def _(t):
    picks = X.maxmin_pick(vectors(t), "vec_id", "v", X.MAX_PICKS)
    return t.spark.createDataFrame([(i, k) for i, k in enumerate(picks)], "pick int, vec_id long")


@query("landmark_embedding", f"""WITH RECURSIVE {PICKS}
SELECT a.vec_id, string_agg(round_even(list_distance(a.e, b.e)*1e6,0)::BIGINT::VARCHAR, ',' ORDER BY b.vec_id) AS features
FROM v a CROSS JOIN (SELECT v.* FROM v JOIN picks ON chosen=vec_id) b GROUP BY 1""")
def _(t):
    points = vectors(t).select("vec_id", "v")
    picks = X.maxmin_pick(points, "vec_id", "v", X.MAX_PICKS)
    return X.landmark_embedding(points, "vec_id", "v", picks).select("vec_id", micro("features").alias("features"))
