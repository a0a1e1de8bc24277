"""Every measured call is a cell of the masked regressions."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from likeness.plans import learning as L
from likeness.plans.base import nation_profiles
from likeness.plans.registry import Tables


def test_calls_graded_zero_are_cells(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    raw = nation_profiles(t)[0]
    entities = raw.select("entity", F.lit(0).alias("split")).distinct()
    cells = L.nation_cells(SimpleNamespace(t=t, entities=entities), L.part_features(t))
    want = {(r["entity"], r["target"]): r["value"] for r in raw.collect()}
    assert sum(v == 0 for v in want.values()) > 100
    assert {(r["entity"], r["target"]): r["value"] for r in cells.select("entity", "target", "value").collect()} == want
