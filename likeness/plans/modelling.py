"""Models trained on the given tables; results carry metrics, not SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from likeness.functions.draws import draw_uint
from likeness.functions.fingerprints import N_BITS
from likeness.operators import boards as B
from likeness.operators import bootstrap as BS
from likeness.operators import metrics as M
from likeness.operators import models as MD
from likeness.operators.processes import task_processes
from likeness.operators.splits import group_disjoint_split
from likeness.plans.likenesses import doc_descriptors, doc_prints, vectors
from likeness.plans.profiling import docs_grouped
from likeness.plans.registry import query
from likeness.session import cut_lineage, scratch_path

TREES = 20  # per forest here but in rf_eval, which has the library's models.TREES
NUMBERS = ["chars", "lines", "words", "vocabulary", "word_length", "digits", "capitals", "marks"]
FOLD = 32


def folded(prints, width=FOLD):
    """(id, counts): set positions (id, bits) folded to ``width`` slots (array<double>); null has none set.

    Counted in one pass over the positions. As nested lambdas Spark put the whole
    fingerprint into the inner one and made it anew for every slot of every row.
    """
    def count(batches):
        for batch in batches:
            bits = batch.column("bits")
            slot = pc.list_flatten(bits).to_numpy(zero_copy_only=False) % width
            row = pc.list_parent_indices(bits).to_numpy(zero_copy_only=False)
            counts = np.bincount(row * width + slot, minlength=len(bits) * width).astype(np.float64)
            offsets = np.arange(len(bits) + 1, dtype=np.int32) * width
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, counts)], ["id", "counts"])

    return prints.select("id", "bits").mapInArrow(count, "id long, counts array<double>")


@F.udf(VectorUDT())
def positions(bits):
    """Set positions as a sparse vector of all N_BITS; null has none set."""
    return Vectors.sparse(N_BITS, bits or [], [1.0] * len(bits or []))


def text_task(t):
    """(task, id, split, y, features): label quality of documents, by language; ``bits`` is the whole fingerprint."""
    grouped = group_disjoint_split(
        t.documents.select("doc_id", "lang").join(cut_lineage(docs_grouped(t), "groups"), "doc_id"), "grp", 0.3, "text")
    bits = doc_prints(t).withColumnRenamed("id", "doc_id")
    rows = grouped.join(t.labels, "doc_id").join(doc_descriptors(t), "doc_id").join(bits, "doc_id")
    side = F.when(F.col("split") == 1, "test").otherwise("train")
    return cut_lineage(rows.select(
        F.col("lang").alias("task"), F.col("doc_id").alias("id"), side.alias("split"),
        F.col("quality").cast("double").alias("y"), *NUMBERS, positions("bits").alias("bits")), "text-task")


FEATURES = {"descriptors": NUMBERS, "fingerprint": ["bits"], "both": [*NUMBERS, "bits"], "length": ["chars"]}


def order_task(t):
    """(task, id, split, y, features): order totals, by priority, split by date."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.count("*").cast("double").alias("lines"),
        F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    side = F.when(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz"), "train").otherwise("test")
    return cut_lineage(t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("id"), side.alias("split"),
        F.log10("o_totalprice").alias("y"), "qty", "lines", "price", "discount", "tax"), "order-task")


ORDER_SETS = {"size": ["qty", "lines"], "all": ["qty", "lines", "price", "discount", "tax"]}


@query("rf_eval")
def _(t):
    data = text_task(t).withColumn("task", F.lit("quality"))
    pred = cut_lineage(MD.task_predictions(data, ["quality"], FEATURES), "pred")
    auc = M.roc_auc(pred.withColumn("pos", F.col("y") == 1), ["task", "method"], "pred", "pos")
    return M.spearman(pred, ["task", "method"], "y", "pred").join(auc, ["task", "method"])


@query("transfer_eval")
def _(t):
    """One score per task and feature set; NULL for tasks below 30 training or 20 test rows."""
    data = text_task(t)
    big = data.groupBy("task").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    tasks = [r["task"] for r in big.filter("a >= 30 AND b >= 20").orderBy("task").select("task").collect()]
    sets = {k: FEATURES[k] for k in ("descriptors", "fingerprint", "both")}
    every = big.select("task", F.explode(F.array(*map(F.lit, sets))).alias("method"))
    if tasks:
        pred = cut_lineage(MD.task_predictions(data, tasks, sets, trees=TREES, min_leaf=2), "pred")
        per = every.join(M.spearman(pred, ["task", "method"], "y", "pred"), ["task", "method"], "left").select(
            "task", "method", "spearman")
    else:
        per = every.withColumn("spearman", F.lit(None).cast("double"))
    mean = per.filter("spearman IS NOT NULL").groupBy("method").agg(F.avg("spearman").alias("spearman"))
    return per.unionByName(mean.select(F.lit("mean").alias("task"), "method", "spearman"))


def label_points(t):
    """(id, y, split, v): the label of a vector as a number to predict."""
    side = F.when(draw_uint("vec_id", seed="gp") % 10 < 7, "train").otherwise("test")
    return vectors(t).select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y"), side.alias("split"), "v")


@query("nystrom_gp")
def _(t):
    """Seven metrics of a process for each of five tasks: exact below 1,200 rows, over 64 landmarks above."""
    points = label_points(t).withColumn("task", F.concat(F.lit("part "), F.pmod(F.col("id"), F.lit(5)).cast("string")))
    pred = cut_lineage(task_processes(points).withColumn("pred", F.round("pred", 9)), "process")
    return M.task_metrics(pred, ["task"], "id", "y", "pred")


def order_predictions(t):
    data = order_task(t)
    return MD.task_predictions(data, MD.task_names(data), ORDER_SETS, trees=TREES)


@query("task_bakeoff")
def _(t):
    pred = cut_lineage(order_predictions(t), "task-pred")
    return M.task_metrics(pred, ["task", "method"], "id", "y", "pred")


@query("board_run")
def _(t):
    """Bootstrap error per endpoint, its macro average, and the place among customers."""
    pred = cut_lineage(order_predictions(t), "board-pred")
    rae = BS.bootstrap_errors(pred, ["task"], "method", "id", "y", "pred", 1000, "board")
    entrants = rae.select(F.col("method").alias("model"), F.col("task").alias("endpoint"), F.round("rae", 9).alias("value"))
    # The finalists: every customer, guessing its own mean total.
    own = t.orders.select(F.col("o_orderpriority").alias("endpoint"), "o_custkey", F.log10("o_totalprice").alias("y"))
    every = own.groupBy("endpoint").agg(F.avg("y").alias("mean"))
    mine = own.groupBy("endpoint", "o_custkey").agg(F.avg("y").alias("guess"))
    joined = own.join(mine, ["endpoint", "o_custkey"]).join(every, "endpoint")
    gap = F.avg(F.abs(F.col("y") - F.col("guess"))) / F.nullif(F.avg(F.abs(F.col("y") - F.col("mean"))), F.lit(0.0))
    boards = joined.groupBy("endpoint", "o_custkey").agg(F.round(gap, 9).alias("value")).dropna()
    overall = boards.groupBy("o_custkey").agg(F.round(F.avg("value"), 9).alias("value"))
    entrants, boards = cut_lineage(entrants, "entrants"), cut_lineage(boards.select("endpoint", "value"), "boards")
    return B.placement_table(entrants, boards, overall, "model", "endpoint")


@query("model_checkpoint", """SELECT o_orderkey AS id, true AS same FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'
 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    """Whether a model and its saved and reloaded copy predict the same."""
    data = order_task(t)
    model = MD.forest(ORDER_SETS["all"], "y", trees=TREES).fit(data.filter("split = 'train'"))
    path = scratch_path(t.spark, "model")
    model.write().save(path)
    again = PipelineModel.load(path)
    test = data.filter("split = 'test'")
    first = model.transform(test).select("id", F.col("pred").alias("before"))
    second = again.transform(test).select("id", F.col("pred").alias("after"))
    return first.join(second, "id").select("id", (F.col("before") == F.col("after")).alias("same"))
