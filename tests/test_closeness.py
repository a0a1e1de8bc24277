"""Neighbours of every record and overlap joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from likeness.operators import closeness as C
from likeness.plans.registry import Tables

QUERIES = entry.queries()


def tables(kind):
    rnd = random.Random(kind)
    if kind == "empty":
        return []
    if kind == "vocabulary":  # few features, all frequent, all sets of one size: every pair shares some
        return [(i, sorted({rnd.randrange(4), 4 + rnd.randrange(5), 9 + rnd.randrange(8), 17 + rnd.randrange(30), 50 + rnd.randrange(60)}))
                for i in range(300)]
    rows = []
    for i in range(160):
        base = [rnd.randrange(10) for _ in range(3)] + [rnd.randrange(10, 4000) for _ in range(rnd.choice([1, 8, 60]))]
        rows.append((3 * i, sorted(set(base))))
        for j in range(rnd.choice([0, 0, 1, 12]) if i % 10 == 0 else 0):  # near copies, some equal
            rows.append((3 * i + 1 + 1000 * j, sorted({*base[:-1], rnd.choice([base[-1], 5000 + j])})))
    return rows + [(90_000, []), (90_001, []), (90_002, [99_999])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, feats array<long>").repartition(5)


def tanimoto(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("kind", ["mixed", "vocabulary", "empty"])
@pytest.mark.parametrize("k, floor, most", [(3, 0.35, 0.999), (8, 0.6, 0.9), (1, 0.2, 1.0)])
def test_every_record_has_its_neighbours(spark, kind, k, floor, most):
    rows = tables(kind)
    want = []
    for a, x in rows:
        x = set(x)
        near = sorted((-tanimoto(x, set(y)), b) for b, y in rows if set(y) != x)
        near = [(s, b) for s, b in near if floor <= -s <= most][:k]
        want += [(a, b, -s, i + 1) for i, (s, b) in enumerate(near)]
    got = C.near_records(frame(spark, rows), k, floor, most).select("a", "b", "sim", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert want or kind == "empty"


@pytest.mark.parametrize("kind", ["mixed", "vocabulary", "empty"])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_overlap_join_is_exact(spark, kind, threshold):
    sets = {a: set(x) for a, x in tables(kind) if x}
    for measure, own in (("tanimoto", C.TANIMOTO), ("containment", C.CONTAINMENT)):
        value = tanimoto if measure == "tanimoto" else lambda x, y: len(x & y) / min(len(x), len(y))
        want = {(a, b) for a in sets for b in sets if a < b and value(sets[a], sets[b]) >= threshold}
        got = C.overlap_join(frame(spark, [(a, sorted(x)) for a, x in sets.items()]), threshold, own).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
        assert all(r["sim"] == value(sets[r["a"]], sets[r["b"]]) for r in got)


def test_few_candidates(spark):
    """Of texts, a twentieth of the pairs at most are compared; equal sets are one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from likeness.plans.likenesses import char_kmers, hashed

    sets = docs.select(F.col("doc_id").alias("id"), hashed(char_kmers(F.col("text"), 8)).alias("feats"))
    ranked = C.ranked_sets(sets.dropDuplicates(["feats"]))
    n = C.candidates(ranked, ranked.select("id", F.lit(0.3).alias("t")), 0.3, C.CONTAINMENT).count()
    assert 0 < n < 0.05 * 1000 * 999 / 2


def test_bounds_save_candidates(spark):
    """Where every record has k near ones, known bounds leave fewer pairs than the floor."""
    ranked = C.ranked_sets(frame(spark, [(i, x) for i, x in tables("vocabulary")]).dropDuplicates(["feats"]))
    plain = C.candidates(ranked, ranked.select("id", F.lit(0.2).alias("t")), 0.2).count()
    known = C.candidates(ranked, C.first_bounds(ranked, 2, 0.2), 0.2).count()
    assert known < 0.9 * plain


def test_identities_of_documents(spark):
    assert QUERIES["sequence_identity_join"](spark, "/root/testdata/sf0.001").count() > 0


def test_near_copies_are_not_all_their_pairs(spark):
    """A group of near copies is held together by links in proportion to its members."""
    from likeness.operators.groups import near_groups

    rows = [(i, [*range(200), 1000 + i]) for i in range(120)] + [(500 + i, [*range(300, 340), 2000 + i]) for i in range(3)] + [(900, []), (901, [])]
    got = {r["id"]: r["group"] for r in near_groups(frame(spark, rows), 0.8).collect()}
    assert got == {i: 0 for i in range(120)} | {500 + i: 500 for i in range(3)} | {900: 900, 901: 900}
    ranked = C.ranked_sets(frame(spark, rows))
    every = C.candidates(ranked, 0.8, 0.8, C.TANIMOTO_OF_LARGER)
    assert every.count() == 120 * 119 // 2 + 3
    groups = ranked.select("id", F.when(F.col("id") < 500, 0).otherwise(F.col("id")).alias("group"))
    assert C.candidates(ranked, 0.8, 0.8, C.TANIMOTO_OF_LARGER, groups).count() == 3


def test_neighbours_without_a_floor(spark):
    """However far they are, each record has its k nearest among those that share a feature."""
    from likeness.plans.evaluation import ANY

    rows = [(i, [i, i + 1, 1000, 2000 + i, 3000 + i, 4000 + i]) for i in range(12)]
    got = C.near_records(frame(spark, rows), 4, ANY, 0.999).groupBy("a").count().collect()
    assert [r["count"] for r in got] == [4] * 12
    want = {a: sorted(((-tanimoto(set(x), set(y)), b) for b, y in rows if b != a))[:4] for a, x in rows}
    found = C.near_records(frame(spark, rows), 4, ANY, 0.999).collect()
    assert {(r["a"], r["b"]) for r in found} == {(a, b) for a, near in want.items() for _, b in near}


def test_teacher_pairs_have_far_neighbours(spark):
    """Parts have structural neighbours below the similarity that counts as close."""
    from likeness.plans.base import CLOSE
    from likeness.plans.evaluation import ANY, Study

    study = Study(Tables(spark, "/root/testdata/sf0.001"))
    of = lambda floor: study.drawn(floor).filter("source = 'structural'").count()
    assert of(ANY) > of(CLOSE)


def test_blocks_travel_as_bitmaps(spark):
    """What a record is copied as has one size, and neighbours are sought once."""
    from likeness.operators.neighbours import weighted_profiles
    from likeness.operators.similarity import _matrix, nearest, packed

    prints = spark.createDataFrame([(1, [0, 7, 2047]), (2, []), (3, None), (4, list(range(2048)))], "id long, bits array<int>")
    rows = packed(prints).orderBy("id").toPandas()
    assert rows["bits"].map(len).tolist() == [256] * 4
    assert _matrix(rows["bits"]).sum(1).tolist() == [3, 0, 0, 2048]
    assert _matrix(rows["bits"])[0].nonzero()[0].tolist() == [0, 7, 2047]
    some = prints.filter("bits IS NOT NULL")
    profiles = spark.createDataFrame([(4, "x", 0.5)], "entity long, target string, value double")
    found = weighted_profiles(nearest(some, some, 2, 0.999), profiles)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1
    assert [tuple(r) for r in found.collect()] == [(1, "x", 0.5)]
