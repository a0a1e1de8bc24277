"""Sets that are counted by blocks."""

import random

import pytest

from likeness.operators import closeness as C
from likeness.operators import postings as PO


@pytest.mark.parametrize("block, cells, meetings", [(200, 40, 30), (10**6, 10**6, 10**6)])
def test_blocks_and_strips_leave_nothing_out(spark, monkeypatch, block, cells, meetings):
    rnd = random.Random(7)
    rows = [(f"s{i}", sorted({rnd.randrange(-30, 30) for _ in range(rnd.choice([1, 5, 25]))})) for i in range(90)] + [("none", []), ("null", None)]
    monkeypatch.setattr(PO, "BLOCK_FEATURES", block)
    monkeypatch.setattr(PO, "LEAST_FEATURES", block)
    frame = spark.createDataFrame(rows, "id string, feats array<long>")
    sets = {a: set(x) for a, x in rows if x}
    want = {(a, b): len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b}
    want = {k: v for k, v in want.items() if v >= 0.6}
    got = {(r["a"], r["b"]): r["sim"] for r in C.overlap_join(frame, 0.6, C.CONTAINMENT).collect()}
    assert got == want
    # A block beside strips of a few cells, counted a few meetings at a time.
    monkeypatch.setattr(PO, "STRIP_CELLS", cells)
    monkeypatch.setattr(PO, "MEETINGS_AT_ONCE", meetings)
    import pyarrow as pa

    held = pa.RecordBatch.from_arrays([pa.array(list(sets)), pa.array([sorted(x) for x in sets.values()], pa.list_(pa.int64())),
                                       pa.array([0] * len(sets), pa.int64()), pa.array([False] * len(sets)), pa.array([True] * len(sets))],
                                      ["id", "feats", "cell", "second", "own"])
    found = [r for b in PO._meet(0.6, "sim")([held.slice(0, 50), held.slice(50)]) for r in b.to_pylist()]
    assert {tuple(sorted((r["x"], r["y"]))): r["sim"] for r in found} == want and len(found) == len(want)


def test_pairs_that_only_meet_are_not_shuffled(spark):
    """One frequent feature makes every pair meet; none of them is a row of an exchange."""
    frame = spark.createDataFrame([(i, [0, *range(10 * i + 1, 10 * i + 9)]) for i in range(300)], "id long, feats array<long>")
    plan = C.overlap_join(frame, 0.5, C.CONTAINMENT)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("JoinHint", "") and plan.count("MapInArrow") >= 1
