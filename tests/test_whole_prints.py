"""Forests learn from whole fingerprints, and rf_eval's have the reference's number of trees."""

import pytest

import __spark_entry__ as entry
from likeness.functions.fingerprints import N_BITS
from likeness.operators import models as MD
from likeness.plans import modelling as ML
from likeness.plans.likenesses import doc_prints
from likeness.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def test_every_position_is_a_feature(spark):
    t = Tables(spark, FOLDER)
    want = {r["id"]: r["bits"] for r in doc_prints(t).collect()}
    rows = ML.text_task(t).select("id", "bits").collect()
    assert rows and all(r["bits"].size == N_BITS and sorted(r["bits"].indices.tolist()) == want[r["id"]] for r in rows)
    null = spark.createDataFrame([(None,)], "bits array<int>").select(ML.positions("bits").alias("v")).first()["v"]
    assert null.size == N_BITS and null.numNonzeros() == 0


def test_trees_of_the_reference(spark, monkeypatch):
    class Asked(Exception):
        pass

    def fit(features, label, trees=MD.TREES, **options):
        raise Asked(trees)

    monkeypatch.setattr(MD, "forest", fit)
    with pytest.raises(Asked) as asked:
        entry.queries()["rf_eval"](spark, FOLDER)
    assert asked.value.args == (500,)
