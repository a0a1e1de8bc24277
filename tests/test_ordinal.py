"""Ordinal ranks in one order by value and key hash."""

import hashlib
import re

from pyspark.sql import functions as F

from likeness.functions.draws import digest
from likeness.operators import metrics as M
from likeness.operators import ordering as O


def windows(df):
    return len(re.findall(r"Window \[", df._jdf.queryExecution().executedPlan().toString()))


def test_a_frequent_value_is_cut_by_its_hash(spark):
    rows = [(i, 0.5 if i % 3 else i / 30_000) for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, v double").withColumn("h", digest("id", seed="x")).cache()
    cut = O.with_bucket(df, "v", "b", tie=F.col("h")).cache()
    assert max(r["count"] for r in cut.groupBy("b").count().collect()) < 500  # before, 20,000 rows were one bucket
    ordered = [r["b"] for r in cut.orderBy("v", "h").collect()]
    assert ordered == sorted(ordered)


def test_ordinal_ranks(spark):
    rows = [(i, i % 2, [0.0, 1.5, 1.5, float(i)][i % 4]) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, task int, v double").cache()
    made = M.ordinal_rank01(df, ["task"], "v", ["id"], "r")
    assert windows(made) <= 3  # before, 5: ranks of values and, for themselves, places within each
    place = lambda i, v: (v, hashlib.md5(f"{i}|rank01".encode()).hexdigest(), i)
    want = {}
    for task in (0, 1):
        own = sorted((place(i, v) for i, t, v in rows if t == task))
        want.update({i: n / (len(own) - 1) for n, (_, _, i) in enumerate(own)})
    assert {r["id"]: r["r"] for r in made.collect()} == want
