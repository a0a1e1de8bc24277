"""Gaussian processes for many tasks at once.

A small task is one group: its exact process is fitted where its rows meet, and
all such tasks in one job. A task with more rows than ``EXACT`` gets a process over
landmarks, whose sums are made where the rows lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.vectors import euclidean
from likeness.operators import features as X
from likeness.operators.models import GAMMAS, NOISES, fit_landmark_process, process_prediction

#: Rows of a task up to which its process is exact; test rows predicted at once.
EXACT, CHUNK = 1200, 4096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def exact_process(points: np.ndarray, y: np.ndarray) -> dict:
    """The best (gamma, noise) by marginal likelihood of standardised targets, and weights of exp(-gamma d).

    One eigendecomposition for each gamma gives all noises. Targets that don't
    vary have weights of zero, so every prediction is their mean.
    """
    mean, std = float(y.mean()), float(y.std()) or 1.0
    z, apart, best = (y - mean) / std, distances(points, points), None
    for gamma in GAMMAS:
        values, axes = np.linalg.eigh(np.exp(-gamma * apart))
        values, along = np.maximum(values, 0.0), axes.T @ z
        for noise in NOISES:
            spread = values + noise
            fit = -0.5 * ((along**2 / spread).sum() + np.log(spread).sum() + len(z) * np.log(2 * np.pi))
            if best is None or fit > best["fit"]:
                best = {"fit": float(fit), "gamma": gamma, "noise": noise, "weights": axes @ (along / spread) * std, "mean": mean}
    return best


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    points = np.stack(rows["v"].to_list())
    model = exact_process(points, rows["y"].to_numpy(float))
    return pd.DataFrame([{"task": rows["task"].iat[0], "gamma": model["gamma"], "mean": model["mean"],
                          "weights": model["weights"], "points": points.ravel(), "width": points.shape[1]}]).astype({"task": object})


def _predicted(model: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    if not len(model) or not len(rows):
        return pd.DataFrame({"task": [], "id": [], "y": [], "pred": []}).astype({"task": object, "id": "int64"})
    m = model.iloc[0]
    points = np.asarray(m["points"]).reshape(-1, int(m["width"]))
    kernel = np.exp(-m["gamma"] * distances(np.stack(rows["v"].to_list()), points))
    return pd.DataFrame({"task": np.asarray(rows["task"], object), "id": rows["id"].to_numpy(), "y": rows["y"].to_numpy(),
                         "pred": m["mean"] + kernel @ np.asarray(m["weights"])})


def task_processes(rows: DataFrame, exact: int = EXACT, landmarks: int = X.MAX_PICKS) -> DataFrame:
    """(task, id, y, pred) of the test rows; ``rows`` is (task, id, split, y, v), vectors of one length.

    Rows without a finite target or vector are left out. Tasks without training
    rows have no predictions.
    """
    rows = rows.filter((F.abs("y") < float("inf")) & F.col("v").isNotNull())
    train, test = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")
    sizes = train.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    small = train.join(sizes.filter(F.col("n") <= exact), "task", "left_semi")
    models = small.groupBy("task").applyInPandas(
        _fitted, "task string, gamma double, mean double, weights array<double>, points array<double>, width int")
    parts = test.groupBy("task").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    spread = models.join(parts, "task").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    dealt = test.join(parts, "task").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    out = spread.groupBy("task", "part").cogroup(dealt.groupBy("task", "part")).applyInPandas(
        _predicted, "task string, id long, y double, pred double")
    for r in sizes.filter(F.col("n") > exact).orderBy("task").collect():  # tasks that are large are few
        out = out.unionByName(_landmark_task(rows.filter(F.col("task") == r["task"]), landmarks))
    return out


def _landmark_task(rows: DataFrame, landmarks: int) -> DataFrame:
    train = rows.filter("split = 'train'")
    picks = X.maxmin_pick(train, "id", "v", landmarks)
    listed = np.array([r["v"] for r in train.filter(F.col("id").isin(*picks)).orderBy("id").select("v").collect()])
    marked = rows.withColumn("_marks", X.vectors_of(train, "id", "v", picks))
    near = marked.select("task", "id", "y", "split", F.transform("_marks", lambda m: euclidean(F.col("v"), m)).alias("d"))
    model = fit_landmark_process(near.filter("split = 'train'").select("d", "y"), distances(listed, listed))
    return near.filter("split = 'test'").select("task", "id", "y", process_prediction("d", model).alias("pred"))
