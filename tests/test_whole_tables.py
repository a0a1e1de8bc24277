"""Buckets from the data, two-pass draws, groups of near texts, replicate sums, picks, curation predicates."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.functions import fingerprints as FP
from likeness.operators import bootstrap as BS
from likeness.operators import features as X
from likeness.operators import groups as G
from likeness.operators import metrics as M
from likeness.operators import ordering as O
from likeness.operators import profiles as P
from likeness.operators import splits as SP
from likeness.plans import base
from likeness.plans.profiling import plain_features
from likeness.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


# --- buckets --------------------------------------------------------------------


@pytest.mark.parametrize("start, width", [(1.7e9, 2e5), (20_240_000.0, 1e4), (0.99, 0.01), (-3.0, 1e-6), (0.0, 1e12)])
def test_buckets_follow_the_data(spark, start, width):
    values = spark.range(50_000).select((F.lit(start) + F.rand(3) * width).alias("v")).cache()
    rows = O.with_bucket(values, "v", "b").cache()
    sizes = [r["count"] for r in rows.groupBy("b").count().collect()]
    assert len(sizes) >= 64 and max(sizes) <= 50_000 / 64
    ordered = [r["b"] for r in rows.orderBy("v").collect()]
    assert ordered == sorted(ordered)


def test_buckets_of_outliers_ties_and_nothing(spark):
    rows = [(1.0,)] * 500 + [(float(x),) for x in range(300)] + [(1e300,), (-1e300,), (None,), (float("nan"),), (float("inf"),)]
    df = spark.createDataFrame(rows, "v double")
    got = O.with_bucket(df, "v", "b").collect()
    known = sorted((r["v"], r["b"]) for r in got if r["v"] is not None and r["v"] == r["v"])
    assert [b for _, b in known] == sorted(b for _, b in known) and len({b for _, b in known}) >= 64
    assert [r["b"] for r in got if r["v"] is None] == [None]
    empty = df.limit(0)
    assert O.value_ranks(empty, [], "v").count() == 0


def test_ranks_by_buckets(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.choice([0.0, -0.0, 1e-300, 5.0, float(rnd.randrange(400)), 1.7e9 + rnd.randrange(100)])) for _ in range(3000)]
    got = {(r["k"], r["v"]): r["avg_rank"] for r in O.value_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in "ab":
        own = np.asarray([v for g, v in rows if g == k])
        for v in set(own.tolist()):
            assert got[k, v] == (own < v).sum() + ((own == v).sum() + 1) / 2


# --- draws ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 501])
def test_two_pass_sample(spark, n):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    whole = [r["k"] for r in O.sample_n(df, "k", n, "s").collect()]
    ordered = [r["k"] for r in df.withColumn("h", F.md5(F.concat_ws("|", "k", F.lit("s")))).orderBy("h", "k").collect()]
    assert sorted(whole) == sorted(ordered[:n])
    per = O.sample_n(df, "k", n, "s", ["g"]).groupBy("g").count().collect()
    assert all(r["count"] == min(n, (500 + 2 - r["g"]) // 3) for r in per) and len(per) == (3 if n else 0)


def test_sample_moves_only_the_edge(spark):
    """Only counts, and the rows of the prefix at the edge, are exchanged."""
    plan = O.sample_n(spark.read.parquet(f"{FOLDER}/orders.parquet"), "o_orderkey", 100, "x")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o_orderkey" not in plan and "rangepartitioning" not in plan


# --- groups of near texts -------------------------------------------------------


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 700)]
    loose = [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(120)]
    links = chain + star + [p for p in loose if p[0] != p[1]]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["root"] for r in G.linked_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert G.linked_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_stay_on_one_side(spark):
    rnd = random.Random(4)
    texts, planted = [], []
    for i in range(120):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
        texts.append(" ".join(words))
        if i % 4 == 0:
            copy = list(words)
            copy[rnd.randrange(80)] = "other"
            planted.append((len(texts) - 1, len(texts)))
            texts.append("  ".join(copy).upper())
    texts += ["", "", None, "12 13", "99 7"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    groups = G.near_groups(df.select("id", plain_features(F.col("text")).alias("feats")), 0.8).cache()
    grp = {r["id"]: r["group"] for r in groups.collect()}
    assert len(grp) == len(texts) and all(grp[a] == grp[b] for a, b in planted)
    n = len(texts)
    assert grp[n - 5] == grp[n - 4] == grp[n - 3] and grp[n - 2] == grp[n - 1] != grp[n - 3]
    assert len(set(grp.values())) == 122
    split = {r["id"]: r["split"] for r in SP.group_disjoint_split(groups, "group", 0.3).collect()}
    assert all(split[a] == split[b] for a, b in planted) and 0 < sum(split.values()) < n


# --- replicate sums -------------------------------------------------------------


def test_bootstrap_against_plain_sums(spark):
    rnd = random.Random(3)
    rows = [(g, m, i, float(i % 17), float(i % 17) + s * rnd.random()) for g, n in (("a", 40), ("b", 3)) for i in range(n)
            for m, s in (("good", 1.0), ("poor", 9.0))]
    df = spark.createDataFrame(rows, "task string, method string, id long, y double, pred double").repartition(4)
    got = {(r["task"], r["method"]): r for r in BS.bootstrap_errors(df, ["task"], "method", "id", "y", "pred", 100, "s").collect()}
    for task in "ab":
        ids = sorted({r[2] for r in rows if r[0] == task})
        w = BS.poisson_weights([f"{task}|{i}" for i in ids], 100, "s")
        y = np.asarray([i % 17 for i in ids], float)
        for method in ("good", "poor"):
            pred = np.asarray([next(r[4] for r in rows if r[:3] == (task, method, i)) for i in ids])
            rates = []
            for rep in range(100):
                own = w[:, rep]
                around = (own * np.abs(y - (own @ y) / own.sum())).sum() if own.sum() else 0.0
                if around > 0:
                    rates.append((own * np.abs(y - pred)).sum() / around)
            r = got[task, method]
            assert r["replicates"] == len(rates)
            assert r["rae"] == pytest.approx(np.mean(rates)) and r["spread"] == pytest.approx(np.std(rates))
    weights = BS.poisson_weights([str(i) for i in range(3000)], 16, "w")
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05


def test_digests_side_by_side():
    """The same digests as hashlib's, for names of any length."""
    import hashlib

    names = [("n\u00e9" * (i % 25)).encode()[:i % 60] + str(i).encode() for i in range(400)]
    ends = [f"|{i}|seed".encode() for i in range(13)]
    want = [b"".join(hashlib.md5(n + e).digest() for e in ends) for n in names]
    assert [bytes(r) for r in BS.digests_of(names, ends)] == want
    assert {len(n) + len(e) for n in names for e in ends} >= set(range(40, 60))


def test_chunks_are_dealt_to_all_cores(spark):
    """A scan of few bytes is few tasks, whatever work its rows are."""
    chunks = spark.range(200).coalesce(1).selectExpr("id AS chunk")
    parts = BS.dealt(chunks).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 200


# --- picks and pooled vectors ---------------------------------------------------


def test_maxmin_picks(spark):
    gen = np.random.default_rng(0)
    v = np.round(gen.normal(size=(90, 5)), 3)
    v[40] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    picks, d = [0], np.full(90, np.inf)
    while len(picks) < 30:
        d = np.minimum(d, np.round(np.sqrt(((v - v[picks[-1]]) ** 2).sum(1)), 6))
        picks.append(int(np.lexsort((np.arange(90), -d))[0]))
    assert X.maxmin_pick(df, "id", "v", 30) == picks
    assert X.maxmin_pick(df.filter("id IN (3, 40)"), "id", "v", 5) == [3]
    assert X.maxmin_pick(df.limit(0), "id", "v", 5) == []


def test_mean_pool_and_medians(spark):
    rows = [(1, [1.0, 2.0], True), (1, [3.0, 6.0], True), (1, [9.0, 9.0], False), (2, [5.0, 5.0], False)]
    df = spark.createDataFrame(rows, "k long, v array<double>, m boolean")
    assert sorted(map(tuple, X.mean_pool(df, "k", "v", F.col("m")).collect())) == [(1, [2.0, 4.0]), (2, [0.0, 0.0])]
    gaps = spark.createDataFrame([(1, [1.0, None]), (2, [3.0, float("nan")]), (3, [None, None]), (4, [8.0, None])], "k long, f array<double>")
    assert sorted(map(tuple, X.median_filled(gaps, "f", 2).collect())) == [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [3.0, 0.0]), (4, [8.0, 0.0])]


# --- curation -------------------------------------------------------------------


@pytest.mark.parametrize("column, accepted", [
    ("units", "nM"), ("type", "A"), ("duplicate", 0), ("comment", None), ("confidence", 9), ("assay_type", "F"),
    ("target_type", "SINGLE PROTEIN"), ("flag", 1), ("validity", None), ("relation", "=")])
def test_every_predicate_rejects_rows(spark, column, accepted):
    m = base.measurements(Tables(spark, FOLDER), strict=True)
    freed = m.withColumn(column, F.lit(accepted).cast(m.schema[column].dataType))
    assert m.filter(base.STRICT_RULES.exact()).count() < freed.filter(base.STRICT_RULES.exact()).count()
    if column not in ("flag", "relation"):
        assert m.filter(base.STRICT_RULES.censored()).count() < freed.filter(base.STRICT_RULES.censored()).count()


def test_both_relations_are_censored(spark):
    kept = base.measurements(Tables(spark, FOLDER), strict=True).filter(base.STRICT_RULES.censored())
    assert {r["relation"] for r in kept.select("relation").distinct().collect()} == {">", ">="}


# --- plans ----------------------------------------------------------------------


def test_few_exchanges(spark):
    df = spark.createDataFrame([("a", "m", i, float(i % 7), float(i % 5)) for i in range(60)],
                               "task string, method string, id long, y double, pred double")
    assert exchanges(M.task_metrics(df, ["task", "method"], "id", "y", "pred")) <= 30
    profiles = spark.createDataFrame([(i % 9, i % 4, 1.0 + i) for i in range(30)], "entity long, target long, value double")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 77)], "a long, b long")
    assert exchanges(P.cosine_of_pairs(pairs, profiles)) <= 8
    got = {(r["a"], r["b"]): r["raw"] for r in P.cosine_of_pairs(pairs, profiles).collect()}
    assert got[3, 77] == 0.0 and 0 < got[1, 2] <= 1


@pytest.mark.parametrize("rows, columns", [(3, 2), (64, 1000)])
def test_matrices_are_whole(spark, rows, columns):
    """Each row has an entry for every column, in order of id, whatever the blocks."""
    import math

    from likeness.operators import similarity as SIM
    from likeness.plans.likenesses import finite_rows

    left = [(i, [float(i), 1.0]) for i in range(7)] + [(8, [float("inf"), 0.0])]
    right = [(10 - i, [0.5 * i, 3.0]) for i in range(9)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, bits array<double>").repartition(3)
    made = SIM.matrix_rows(frame(left), frame(right), SIM.euclidean_distances, row_block=rows, column_block=columns)
    got = {r["id"]: r["distances"] for r in finite_rows(made).collect()}
    gaps = {i: [math.dist(v, w) for _, w in sorted(right)] for i, v in left}
    top = max(g for i, gap in gaps.items() for g in gap if math.isfinite(g))
    assert got == {i: ",".join(str(round((g if math.isfinite(g) else top) * 1e6)) for g in gap) for i, gap in gaps.items()}


def test_matrix_queries_have_all_columns(spark):
    from likeness.plans import catalogue

    first = catalogue.QUERIES["tanimoto_matrix"](spark, "/root/testdata/sf0.001").selectExpr("size(split(distances, ','))").distinct().collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert [r[0] for r in first] == [items]
