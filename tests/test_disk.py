"""What lies on disk while sets are ranked and once a table is written."""

import time

from pyspark.sql import functions as F

from likeness import session as S
from likeness.operators import closeness as C


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffles_of_a_written_table_are_deleted(spark):
    before = shuffle_files(spark)
    rows = spark.range(2000).withColumn("k", F.col("id") % 7).repartition(5, "id").groupBy("k").agg(F.count("*").alias("n"))
    kept = S.cut_lineage(rows, "counts")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(S.CLEAN_CONF, None) is None
    assert sorted((r["k"], r["n"]) for r in kept.collect())[0] == (0, 286)
    assert kept.join(rows, "k").count() == 7  # the plan itself can still run


def test_ranked_features_travel_as_plain_numbers(spark, monkeypatch):
    made = []
    monkeypatch.setattr(C, "cut_lineage", lambda df, name: made.append(df) or df)
    sets = [(1, [5, 6, 7, 8]), (2, [6, 7, 9]), (3, [7, 8, 5]), (4, [7, 11])]
    got = C.ranked_sets(spark.createDataFrame(sets, "id long, feats array<long>").repartition(3))
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct" not in plan and "collect_list(df" in plan
    df = {f: sum(f in feats for _, feats in sets) for f in range(20)}
    want = {i: (len(feats), sorted((f for f in feats if df[f] > 1), key=lambda f: (df[f], f))) for i, feats in sets}
    assert {r["id"]: (r["n"], r["common"]) for r in got.collect()} == want
