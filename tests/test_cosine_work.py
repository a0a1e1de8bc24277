"""Two profiles meet in time proportional to their sizes, and few pairs are dealt to many tasks."""

from likeness.operators import profiles as P


def test_profiles_meet_by_hash(spark):
    cells = [(e, 3 * t + e % 3, 1.0 + t % 7) for e in range(6) for t in range(300)]
    profiles = spark.createDataFrame(cells, "entity long, target long, value double")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "a long, b long")
    found = P.cosine_of_pairs(pairs, profiles)
    for row in found.collect():
        same = row["a"] % 3 == row["b"] % 3  # the same targets and values, or none in common
        assert abs(row["raw"] - same) < 1e-9
    # Every target of one was sought along the whole of the other.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array_position" not in plan
    # All pairs were one task, as they are few bytes.
    assert "REPARTITION_BY_NUM" in plan
