"""Profiles travel with their pairs as rows of arrays, in segments where they are wide."""

import math
import random

import pytest

from likeness.operators import profiles as P


@pytest.mark.parametrize("segment", [256, 3])
def test_profiles_travel_as_rows(spark, monkeypatch, segment):
    monkeypatch.setattr(P, "SEGMENT", segment)
    rng = random.Random(5)
    cells = {e: {t: rng.uniform(-2, 2) for t in rng.sample(range(20), rng.randint(1, 12))} for e in range(30)}
    cells[31] = {99: 1.0}  # shares nothing
    profiles = spark.createDataFrame([(e, t, v) for e, own in cells.items() for t, v in own.items()], "entity long, target long, value double")
    units, n = P.unit_rows(profiles)
    widest = max(map(len, cells.values()))
    assert n == -(-widest // segment) and units.filter("segment = 0").count() == len(cells)
    if segment == 256:
        assert units.count() == len(cells)  # before, one row for each cell met the pairs
    pairs = [(i, a, b) for i, (a, b) in enumerate([(a, b) for a in range(0, 34, 3) for b in range(34)] + [(1, 2), (1, 2)])]
    got = {r["draw"]: (r["raw"], r["size_a"], r["size_b"]) for r in P.with_cosine(
        spark.createDataFrame(pairs, "draw long, a long, b long"), (units, n)).collect()}
    length = lambda e: math.sqrt(sum(v * v for v in cells[e].values()))
    assert len(got) == len(pairs)
    for i, a, b in pairs:
        x, y = cells.get(a), cells.get(b)
        raw = sum(v * y.get(t, 0.0) for t, v in x.items()) / length(a) / length(b) if x and y else 0.0
        assert got[i] == (pytest.approx(raw, abs=1e-12), x and len(x), y and len(y))
