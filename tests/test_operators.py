"""Operators on small fixtures, against brute force and stated properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from likeness.functions import fingerprints as FP
from likeness.functions import scalars as S
from likeness.functions import vectors as V
from likeness.operators import boards as B
from likeness.operators import calls as C
from likeness.operators import clouds as CL
from likeness.operators import lineage as L
from likeness.operators import metrics as M
from likeness.operators import models as MD
from likeness.operators import ordering as O
from likeness.operators import profiles as P
from likeness.operators import similarity as SIM
from likeness.operators import splits as SP
from likeness.operators import transport as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- ordering -----------------------------------------------------------------

VALUES = [-1e9, -3.5, -3.5, -1e-12, 0.0, 0.0, 0.0, 1e-300, 0.5, 0.5000001, 7.0, 1e18]


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_ranks_do_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = frame(spark, [("g", v) for v in VALUES], "k string, v double").repartition(5)
        got = {r["v"]: r["avg_rank"] for r in O.value_ranks(df, ["k"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == pd.Series(VALUES).rank().groupby(VALUES).first().to_dict()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.4, 0.5, 0.75, 1.0])
def test_quantile_is_linear(spark, q):
    df = frame(spark, [("g", v) for v in VALUES], "k string, v double")
    assert O.quantile(df, ["k"], "v", q).first()["quantile"] == pytest.approx(np.quantile(VALUES, q))


def test_positions_are_dense_and_samples_whole(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    idx = [r["idx"] for r in O.dense_index(df, "k", 1).collect()]
    assert sorted(idx) == list(range(1000))
    assert O.sample_n(df, "k", 37, 1).count() == 37
    assert O.sample_n(df, "k", 5000, 1).count() == 1000


def test_top_fraction_splits_a_tie_exactly(spark):
    df = frame(spark, [("g", i, 1.0 if i < 95 else 2.0) for i in range(100)], "k string, id long, s double")
    out = O.top_fraction(df, ["k"], "s", "id", 0.1).filter("in_top").collect()
    assert len(out) == 10 and sum(r["s"] == 2.0 for r in out) == 5


# --- scalars and calls --------------------------------------------------------


def test_scalar_edges(spark):
    df = frame(spark, [("NaN",), ("inf",), ("1e3",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(S.finite("t")).collect()] == [None, None, 1000.0, None, None]
    one = spark.range(1)
    assert one.select(S.grade_ramp(F.lit(4.5)), S.grade_ramp(F.lit(5.25)), S.grade_ramp(F.lit(6.0))).first()[:] == (-1.0, 0.0, 1.0)
    assert one.select(S.extract_number(F.lit("0.53 +- 0.1"))).first()[0] == 0.53
    assert one.select(S.extract_number(F.lit("none"))).first()[0] is None
    a = one.select(S.conditions_hash(F.lit(None).cast("string"), F.lit("b"))).first()[0]
    assert a == one.select(F.substring(F.md5(F.lit("|b")), 1, 16)).first()[0]
    assert one.select(S.distance_to_similarity(F.lit(0.0))).first()[0] == 1.0


def test_calls_edges(spark):
    exact = frame(spark, [
        (1, 1, "A", "x", 5.0), (1, 1, "A", "x", 6.0),  # spread exactly 1: kept
        (2, 1, "A", "x", 4.0), (2, 1, "A", "x", 5.5),  # too wide
        (3, 1, "A", "x", 5.25), (3, 1, "B", "y", 6.0), (3, 1, "B", "y", 6.0),  # two beat one
    ], "entity long, target long, type string, ach string, potency double")
    censored = frame(spark, [
        (1, 1, "A", "x", 4.0), (4, 1, "A", "x", 4.5), (5, 1, "A", "x", 4.0), (5, 1, "A", "x", 4.6),
    ], "entity long, target long, type string, ach string, bound double")
    got = rows(C.activity_calls(exact, censored))
    assert got == [(1, 1, pytest.approx(1 / 3), "exact"), (3, 1, 1.0, "exact"), (4, 1, -1.0, "censored")]


def test_idf_does_not_count_zero_grades(spark):
    raw = frame(spark, [(1, 1, 0.0), (2, 1, 1.0), (2, 2, -1.0)], "entity long, target long, value double")
    assert rows(P.target_idf(raw)) == [(1, 1, pytest.approx(math.log(2))), (2, 1, pytest.approx(math.log(2)))]


def test_cosine_of_empty_profile_is_zero(spark):
    prof = frame(spark, [(1, 1, 1.0), (2, 1, 2.0), (2, 2, 2.0), (3, 3, 0.0)], "entity long, target long, value double")
    pairs = frame(spark, [(1, 2), (1, 3), (1, 9)], "a long, b long")
    assert rows(P.cosine_of_pairs(pairs, prof)) == [(1, 2, pytest.approx(math.sqrt(0.5))), (1, 3, 0.0), (1, 9, 0.0)]


def test_size_bins(spark):
    edges = [0, 1, 2, 4, 5, 34, 10**6]
    df = frame(spark, [(e,) for e in edges], "s long")
    assert [r[0] for r in df.select(P.size_bin(F.col("s"))).collect()] == list(np.digitize(edges, P.SIZE_EDGES))


# --- lineage and splits -------------------------------------------------------


def test_lineage_takes_the_deepest_path(spark):
    df = frame(spark, [(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "x"]), (2, ["a", "b", "c", "d"]), (3, ["a", "b"])],
               "target long, path array<string>")
    assert rows(L.lineage_similarity(df)) == [(1, 2, pytest.approx(4 / 6))]
    merged = rows(L.max_merge([L.lineage_similarity(df)], df.select("target").distinct()))
    assert merged == [(1, 1, 1.0), (1, 2, pytest.approx(4 / 6)), (2, 1, pytest.approx(4 / 6)), (2, 2, 1.0), (3, 3, 1.0)]


def test_splits_keep_groups_whole(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 37).alias("g"))
    split = SP.group_disjoint_split(df, "g", 0.2)
    audit = SP.split_audit(split, "g").first()
    assert audit["leaking_groups"] == 0 and audit["test"] >= 100
    fit = df.join(SP.first_fit_groups(SP.group_sizes(df, "g"), "g", 0.7), "g")
    audit = SP.split_audit(fit, "g").first()
    assert audit["leaking_groups"] == 0 and 300 <= audit["train"] <= 350


# --- similarity ---------------------------------------------------------------


@pytest.fixture(scope="module")
def prints(spark):
    rng = np.random.default_rng(0)
    sets = [sorted(set(rng.integers(0, 60, rng.integers(1, 40)).tolist())) for _ in range(120)]
    sets += [sets[0]] * 3 + [[]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, bits array<int>").cache()
    return df, sets


def tani(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_nearest_is_exact(prints):
    df, sets = prints
    got = {}
    for r in SIM.nearest(df, df, 5, 0.999).collect():
        got.setdefault(r["a"], []).append((r["rank"], r["b"], r["sim"]))
    for a, s in enumerate(sets):
        best = sorted((-tani(s, o), b) for b, o in enumerate(sets) if 0 < tani(s, o) <= 0.999)[:5]
        assert [(b, sim) for _, b, sim in sorted(got.get(a, []))] == [(b, -v) for v, b in best]


def test_threshold_join_is_exact(prints):
    df, sets = prints
    want = sorted((a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if tani(sets[a], sets[b]) >= 0.35)
    assert sorted((r["a"], r["b"]) for r in SIM.tanimoto_join(df, 0.35).collect()) == want


def test_short_and_empty_texts(spark):
    df = frame(spark, [(1, ""), (2, " \n"), (3, "One"), (4, "one ONE one")], "id long, text string")
    for kind in ("ngram2", "ngram3", "class", "path", "pair", "quad"):
        out = {r["id"]: r["bits"] for r in df.select("id", FP.bits(FP.tokens(F.col("text")), kind).alias("bits")).collect()}
        assert out[1] == out[2] == []
        assert (out[3] == []) == (kind in ("pair", "quad"))


def test_zero_vectors(spark):
    one = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("z"), F.array(F.lit(3.0), F.lit(4.0)).alias("v"))
    assert one.select(V.cosine(F.col("z"), F.col("v"))).first()[0] == 0.0
    assert one.select(V.unit(F.col("z")), V.unit(F.col("v"))).first()[:] == ([0.0, 0.0], [0.6, 0.8])


# --- clouds and transport -----------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = [(int(e), int(rng.integers(0, 3)), float(np.round(rng.normal() * 50, 2))) for e in (1, 2) for _ in range(30)]
    data += [(3, 1, 5.0), (4, 0, 2.0), (4, 0, 2.0), (4, 2, -2.0)]
    return spark.createDataFrame(data, "entity long, s int, x double").cache(), data


def test_set_distances_equal_all_pairs(points):
    df, data = points
    got = {tuple(r)[:3]: r["distance"] for r in CL.set_distances(df, 3).collect()}
    want = {}
    for e in (1, 2, 3, 4):
        for i in range(3):
            for j in range(i + 1, 3):
                a = [x for k, s, x in data if (k, s) == (e, i)]
                b = [x for k, s, x in data if (k, s) == (e, j)]
                if a and b:
                    want[e, i, j] = np.abs(np.subtract.outer(a, b)).mean()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_cloud_descriptors_equal_all_pairs(points):
    df, data = points
    out = {r["entity"]: r for r in CL.cloud_descriptors(df.withColumn("type", F.col("s").cast("string")), ["0", "1", "2"]).collect()}
    for e in (1, 2, 4):
        x = np.array([v for k, _, v in data if k == e])
        d = np.abs(np.subtract.outer(x, x))[np.triu_indices(len(x), 1)]
        assert [out[e]["mean"], out[e]["std"], out[e]["highest"]] == pytest.approx([d.mean(), d.std(), d.max()])
    assert out[3]["n"] == 1 and out[3]["mean"] == out[3]["std"] == out[3]["highest"] == 0.0


COST = [[0.0, 0.5, 1.0], [0.5, 0.0, 0.4], [1.0, 0.4, 0.0]]


def cloud_batch(pairs):
    cols = {f"{n}_{s}": [p[k][n] for p in pairs] for k, s in enumerate("ab") for n in ("types", "weights", "dist")}
    return pd.DataFrame(cols)


def make_cloud(rng, n):
    x = rng.normal(size=n)
    return {"types": rng.integers(0, 3, n), "weights": np.full(n, 1 / n), "dist": list(np.abs(np.subtract.outer(x, x)))}


def test_transport_properties():
    rng = np.random.default_rng(2)
    a, b, one = make_cloud(rng, 5), make_cloud(rng, 3), make_cloud(rng, 1)
    order = [3, 1, 4, 0, 2]
    mixed = {"types": a["types"][order], "weights": a["weights"], "dist": list(np.array(a["dist"])[np.ix_(order, order)])}
    batch = cloud_batch([(a, b), (b, a), (mixed, b), (a, a), (one, b), (one, one)])
    cost, plan = T.solve(batch, np.array(COST), np.full(6, 0.5), 0.05, 200, 50, 1e-9)
    assert (cost >= 0).all() and np.isfinite(cost).all()
    assert cost[0] == pytest.approx(cost[1], abs=1e-4) and cost[0] == pytest.approx(cost[2], abs=1e-4)
    assert cost[3] < cost[0] and cost[5] == 0.0
    assert plan.sum((1, 2)) == pytest.approx(np.ones(6), abs=1e-9)
    assert plan[0].sum(0)[:3] == pytest.approx(np.full(3, 1 / 3), abs=1e-9)
    alone, _ = T.solve(cloud_batch([(a, b)]), np.array(COST), np.array([0.5]), 0.05, 200, 50, 1e-9)
    assert alone[0] == pytest.approx(cost[0], abs=1e-12)  # padding does not matter


def test_transport_of_two_points_against_a_scan():
    """Couplings of two points with two points have one free number: try them all.

    The regularisation is strong, for near a permutation scaling hardly moves and logs of its small entries say little.
    """
    eps = 0.5
    cloud = lambda types, d: {"types": types, "weights": [0.5, 0.5], "dist": [[0.0, d], [d, 0.0]]}
    for types_a, types_b in (([0, 1], [1, 0]), ([0, 2], [2, 1]), ([1, 0], [2, 0])):
        _, plan = T.solve(cloud_batch([(cloud(types_a, 1.0), cloud(types_b, 3.0))]), np.array(COST), np.array([0.5]), eps, 500, 200, 1e-12)
        x = plan[0, 0, 0]
        assert plan[0].sum(0) == pytest.approx([0.5, 0.5], abs=1e-12) and plan[0].sum(1) == pytest.approx([0.5, 0.5], abs=1e-12)
        # Stationary: no scaling of rows and columns is left over in plan * exp(cost / eps).
        colour = np.array(COST)[np.ix_(types_a, types_b)]
        unit = np.array([[0.0, 1.0], [1.0, 0.0]])
        shape = np.array([[((unit[i][:, None] - unit[j][None]) ** 2 * plan[0]).sum() for j in (0, 1)] for i in (0, 1)])
        tilt = np.log(plan[0]) + 0.5 * (colour + shape) / eps
        assert tilt[0, 0] + tilt[1, 1] == pytest.approx(tilt[0, 1] + tilt[1, 0], abs=1e-5)
        grid = np.linspace(1e-6, 0.5 - 1e-6, 20001)
        cells = np.stack([grid, 0.5 - grid, 0.5 - grid, grid])
        cost = (colour.ravel()[:, None] * cells).sum(0)
        bent = 2 * grid * (1 - 2 * grid) * 2  # sum over (i,k,j,l) of (unit_ij - unit_kl)^2 plan plan
        energy = 0.5 * cost + 0.25 * bent + eps * (cells * np.log(cells)).sum(0)
        near = energy[np.abs(grid - x) < 0.02]
        assert np.interp(x, grid, energy) <= near.min() + 1e-4  # a minimum of its neighbourhood


def test_landmark_process_equals_the_dense_formula(spark):
    """Evidence and weights against the n x n covariance, and constant or missing targets."""
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(40, 2)), rng.normal(size=(6, 2))
    d = np.sqrt(((x[:, None] - z[None]) ** 2).sum(-1))
    between = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    y = np.sin(x[:, 0]) + 0.1 * rng.normal(size=40)
    cells = lambda ys: frame(spark, [(r.tolist(), v) for r, v in zip(d, ys)], "d array<double>, y double")
    model = MD.fit_landmark_process(cells([float(v) for v in y]), between)
    t = (y - y.mean()) / y.std()
    best = None
    for gamma in MD.GAMMAS:
        k, prior = np.exp(-gamma * d), np.exp(-gamma * between)
        for noise in MD.NOISES:
            cov = k @ np.linalg.inv(prior) @ k.T + noise * np.eye(40)
            fit = -0.5 * (t @ np.linalg.solve(cov, t) + np.linalg.slogdet(cov)[1] + 40 * np.log(2 * np.pi))
            if best is None or fit > best[0]:
                best = (fit, gamma, noise, np.linalg.solve(k.T @ k + noise * prior, k.T @ t) * y.std())
    assert (model["gamma"], model["noise"]) == best[1:3]
    assert model["fit"] == pytest.approx(best[0], rel=1e-6) and model["weights"] == pytest.approx(best[3], rel=1e-5)
    flat = MD.fit_landmark_process(cells([2.0] * 40), between)
    assert np.abs(flat["weights"]).max() < 1e-9 and flat["mean"] == 2.0
    none = MD.fit_landmark_process(cells([None] * 40), between)
    assert none["mean"] is None


# --- metrics and boards -------------------------------------------------------


def test_metric_guards(spark):
    few = [("few", i, float(i), float(i)) for i in range(4)]
    flat = [("flat", i, float(i), 1.0) for i in range(20)]
    good = [("good", i, float(i % 7), float((i * 3) % 11)) for i in range(40)] + [("good", 99, float("nan"), 1.0)]
    df = frame(spark, few + flat + good, "task string, id long, y double, pred double")
    out = {r["task"]: r for r in M.task_metrics(df, ["task"], "id", "y", "pred").collect()}
    assert out["few"]["spearman"] is None and out["flat"]["mae"] is None
    assert out["good"]["n"] == 40
    y, p = (pd.Series([r[k] for r in good[:40]]) for k in (2, 3))
    assert out["good"]["spearman"] == pytest.approx(y.rank().corr(p.rank()))
    assert out["good"]["pearson"] == pytest.approx(y.corr(p))


def test_regimes(spark):
    data = [(i, "m", s, float(i % 5), float(i)) for i, s in enumerate([0.35, 0.60, 0.1] + [0.9] * 99)]
    df = frame(spark, data, "id long, method string, sim double, score double, z double")
    out = {r["regime"]: r for r in M.regime_metrics(df, "method", "score", "z", "sim").collect()}
    assert out["overall"]["n"] == 102 and out["overall"]["spearman"] is not None
    assert out["scaffold_hop"]["n"] == 1 and out["cliff"]["n"] == 99 and out["cliff"]["auc"] is None


def test_single_class_has_no_auc(spark):
    df = frame(spark, [("a", 1.0, True), ("a", 2.0, True)], "k string, s double, p boolean")
    assert M.roc_auc(df, ["k"], "s", "p").first()["auc"] is None


# Published Spearman values of 18 endpoints: control, cloud features, cloud process.
GRID = """0.549 0.581 0.472
0.200 0.045 0.066
0.472 0.467 0.586
0.773 0.728 0.755
0.631 0.249 0.400
0.832 0.801 0.759
0.762 0.628 0.508
0.627 0.481 nan
0.432 0.312 nan
0.416 0.323 nan
0.453 0.343 nan
0.572 0.216 nan
0.420 0.277 nan
0.557 0.422 nan
0.599 0.589 0.427
0.720 0.680 0.692
0.509 0.589 nan
0.619 0.611 0.581"""


def test_published_summary(spark):
    data = [(i, m, float(v)) for i, line in enumerate(GRID.splitlines())
            for m, v in zip(("control", "cloud", "process"), line.split())]
    df = frame(spark, data, "endpoint int, method string, value double")
    means = {r["method"]: r["mean"] for r in B.finite_mean(df, ["method"], "value", "mean").collect()}
    assert means == {"control": pytest.approx(0.564, abs=1e-3), "cloud": pytest.approx(0.463, abs=1e-3),
                     "process": pytest.approx(0.525, abs=1e-3)}
    duel = {r["method"]: tuple(r)[1:] for r in B.head_to_head(df, "control", ["endpoint"]).collect()}
    assert duel["cloud"] == (2, 18, pytest.approx(-0.100, abs=1e-3))
    assert duel["process"] == (1, 10, pytest.approx(-0.091, abs=1e-3))


def test_board_ranks_with_ties(spark):
    board = frame(spark, [("e", v) for v in (0.5, 0.6, 0.6, 0.9)], "endpoint string, value double")
    entrants = frame(spark, [("a", "e", 0.4), ("b", "e", 0.6), ("c", "e", 1.0)], "model string, endpoint string, value double")
    out = {r["model"]: (r["rank"], r["percentile"], r["finalists"]) for r in B.rank_against_board(entrants, board, ["endpoint"]).collect()}
    assert out == {"a": (1, 0.0, 4), "b": (2, 25.0, 4), "c": (5, 100.0, 4)}


# --- models -------------------------------------------------------------------


def test_masked_regression_uses_observed_rows_only(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    seen = [(int(t), x[i].tolist(), float(x[i] @ np.arange(4) + t)) for i in range(60) for t in (1, 2) if (i + t) % 3]
    got = {r["target"]: r["weights"] for r in
           MD.masked_regression(frame(spark, seen, "target long, x array<double>, value double"), 4).collect()}
    for t in (1, 2):
        a = np.array([s[1] for s in seen if s[0] == t])
        y = np.array([s[2] for s in seen if s[0] == t])
        assert got[t] == pytest.approx(np.linalg.solve(a.T @ a + np.eye(4), a.T @ y))


def test_landmark_process_with_all_points_fits(spark):
    x = np.linspace(0, 1, 30)
    d = np.abs(np.subtract.outer(x, x))
    y = np.sin(6 * x)
    train = frame(spark, [(row.tolist(), float(v)) for row, v in zip(d, y)], "d array<double>, y double")
    model = MD.fit_landmark_process(train, d)
    pred = np.array([r[0] for r in train.select(MD.process_prediction("d", model)).collect()])
    assert np.abs(pred - y).max() < 0.15


def test_missing_scores_have_no_rank(spark):
    from likeness.operators.metrics import roc_auc, spearman

    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = [("a", odd[i // 10 % 4] if i % 10 == 0 else float(i), float(i), i >= 75) for i in range(150)]
    df = spark.createDataFrame(rows, "task string, score double, truth double, active boolean")
    assert abs(roc_auc(df, ["task"], "score", "active").first()["auc"] - 1) < 1e-12
    assert abs(spearman(df, ["task"], "score", "truth").first()["spearman"] - 1) < 1e-12
