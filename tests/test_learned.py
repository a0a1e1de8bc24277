"""Learned representations and processes against planted structure and plain formulas."""

import numpy as np
import pytest

from likeness.operators import learned as LE
from likeness.operators import models as MD
from likeness.operators import processes as PR


def rank(x):
    return np.argsort(np.argsort(x))


def cosine(a, b):
    return (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)


# --- processes ------------------------------------------------------------------


def test_exact_process_is_the_dense_formula():
    gen = np.random.default_rng(0)
    x = gen.normal(size=(200, 3))
    y = np.sin(x[:, 0]) + 0.1 * gen.normal(size=200)
    model = PR.exact_process(x, y)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    z = (y - y.mean()) / y.std()
    best = None
    for gamma in MD.GAMMAS:
        for noise in MD.NOISES:
            c = np.exp(-gamma * apart) + noise * np.eye(200)
            fit = -0.5 * (z @ np.linalg.solve(c, z) + np.linalg.slogdet(c)[1] + 200 * np.log(2 * np.pi))
            if best is None or fit > best[0]:
                best = fit, gamma, noise, np.linalg.solve(c, z) * y.std()
    assert model["fit"] == pytest.approx(best[0]) and (model["gamma"], model["noise"]) == best[1:3]
    assert np.allclose(model["weights"], best[3], atol=1e-6)


def test_processes_of_many_tasks(spark):
    gen = np.random.default_rng(1)
    rows = []
    for task, n, scale in (("large", 400, 1.0), ("small", 60, 1.0), ("flat", 20, 0.0), ("one", 1, 1.0)):
        x = gen.uniform(-2, 2, (n + 50, 2))
        for i, v in enumerate(x):
            rows.append((task, i, "train" if i < n else "test", float(scale * np.sin(v[0]) + 5), v.tolist()))
    rows += [("only test", 1, "test", 1.0, [0.0, 0.0]), ("small", 999, "train", None, [0.0, 0.0]), ("small", 998, "train", 1.0, None)]
    df = spark.createDataFrame(rows, "task string, id long, split string, y double, v array<double>").repartition(6)
    got = PR.task_processes(df, exact=100, landmarks=16).toPandas()
    assert dict(got.groupby("task").size()) == {"large": 50, "small": 50, "flat": 50, "one": 50}
    for task in ("large", "small"):
        own = got[got.task == task]
        assert np.abs(own.y - own.pred).mean() < 0.25 * np.abs(own.y - own.y.mean()).mean()
    assert np.allclose(got[got.task == "flat"].pred, 5.0)
    own = {r["id"]: r["pred"] for r in PR.task_processes(df.filter("task = 'small'")).collect()}
    x = {r[1]: (r[4], r[3], r[2]) for r in rows if r[0] == "small" and r[3] is not None and r[4] is not None}
    train = sorted(i for i in x if x[i][2] == "train")
    model = PR.exact_process(np.array([x[i][0] for i in train]), np.array([x[i][1] for i in train]))
    for i, pred in own.items():
        d = np.sqrt(((np.array([x[j][0] for j in train]) - np.array(x[i][0])) ** 2).sum(1))
        assert pred == pytest.approx(model["mean"] + np.exp(-model["gamma"] * d) @ model["weights"])
    assert PR.task_processes(df.limit(0)).count() == 0


# --- learned representations ------------------------------------------------------


def planted(seed, n=400, width=12, targets=30, rank_=3):
    gen = np.random.default_rng(seed)
    x = np.c_[gen.normal(size=(n, width - 1)), np.ones(n)]
    hidden = x[:, :width - 1] @ gen.normal(size=(width - 1, rank_)) / 3
    values = np.tanh(hidden @ gen.normal(size=(rank_, targets)))
    seen = gen.random((n, targets)) < 0.5
    return x, hidden, values, seen


def test_masked_tanh(spark):
    x, _, values, seen = planted(2)
    cells = [(int(t), x[i].tolist(), float(values[i, t])) for i in range(300) for t in range(30) if seen[i, t]]
    df = spark.createDataFrame(cells, "target long, x array<double>, value double").repartition(4).cache()
    targets, w = LE.masked_tanh(df, 12, ridge=0.01)
    assert targets == list(range(30))
    bounded = np.abs(np.tanh(x[300:] @ w) - values[300:]).mean()
    plain = np.array([r["weights"] for r in sorted(MD.masked_regression(df, 12, 0.01).collect(), key=lambda r: r["target"])]).T
    assert bounded < 0.5 * np.abs(x[300:] @ plain - values[300:]).mean() and np.abs(np.tanh(x @ w)).max() <= 1
    assert LE.masked_tanh(df.limit(0), 12) == ([], pytest.approx(np.zeros((12, 0))))


def test_factors_of_unseen_entities(spark):
    x, hidden, values, seen = planted(3)
    big = 10**12  # keys beyond 32 bits
    cells = [(big + i, big + int(t), float(values[i, t])) for i in range(300) for t in range(30) if seen[i, t]]
    features = spark.createDataFrame([(big + i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    known = LE.factors(spark.createDataFrame(cells, "entity long, target long, value double"), 4, 10, 0.01).cache()
    assert known.count() == 300
    matrix = LE.fold_in(features, known, 12, 4)
    v = {r["id"] - big: np.array(r["v"]) for r in LE.embedded(features, matrix).collect()}
    gen = np.random.default_rng(0)
    a, b = gen.integers(300, 400, 500), gen.integers(300, 400, 500)
    a, b = a[a != b], b[a != b]
    own = cosine(np.array([v[i] for i in a]), np.array([v[i] for i in b]))
    assert np.corrcoef(rank(own), rank(cosine(values[a], values[b])))[0, 1] > 0.7


def test_pair_metric_beats_cosine(spark):
    gen = np.random.default_rng(5)
    x = gen.normal(size=(300, 10))
    x[:, 3:] *= 3  # most of the length says nothing
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    told = x[:, :3] / np.linalg.norm(x[:, :3], axis=1, keepdims=True)
    a, b = gen.integers(0, 200, 3000), gen.integers(0, 200, 3000)
    pairs = spark.createDataFrame([(x[i].tolist(), x[j].tolist(), float(told[i] @ told[j])) for i, j in zip(a, b)],
                                  "xa array<double>, xb array<double>, truth double").repartition(4).cache()
    p = LE.pair_metric(pairs, 10, 4, 80)
    a, b = gen.integers(200, 300, 2000), gen.integers(200, 300, 2000)
    truth = rank((told[a] * told[b]).sum(1))
    learned = np.corrcoef(rank(cosine(x[a] @ p, x[b] @ p)), truth)[0, 1]
    assert learned > 0.9 and learned > np.corrcoef(rank((x[a] * x[b]).sum(1)), truth)[0, 1] + 0.1


def test_folded_counts(spark):
    """Each position is counted once, and the fingerprint isn't made anew for every slot."""
    from likeness.functions import fingerprints as FP
    from likeness.plans.modelling import folded
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, None)], "id long, text string")
    prints = rows.select("id", FP.bits(FP.tokens(F.col("text"))).alias("bits"))
    out = folded(prints, 16)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
    assert "filter(transform" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {r["id"]: np.bincount(np.asarray(r["bits"] or [], int) % 16, minlength=16).tolist() for r in prints.collect()}
    assert {r["id"]: r["counts"] for r in out.collect()} == want


def test_pair_rows_are_bytes():
    """Numbers of a pair come back from their bytes, also from a slice of a batch."""
    import pyarrow as pa

    a, b, y = (np.random.default_rng(i).random((7, 3)) for i in range(3))
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([lists(a), lists(b), pa.array(y[:, 0])], ["xa", "xb", "truth"])
    (rows,) = LE._joined([batch])
    assert (LE._numbers(rows["row"].slice(2, 4)) == np.column_stack([a, b, y[:, 0]])[2:6]).all()
