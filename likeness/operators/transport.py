"""Entropic fused Gromov-Wasserstein costs for a table of cloud pairs.

Spark spreads the pairs; inside a task the pairs of a batch are solved together
with arrays padded to the largest cloud. Clouds are small by construction.

The couplings are found by mirror descent on the set of couplings: every step
takes the geometric mean of the present plan and of the Gibbs kernel of its
linearised cost, then scales rows and columns back to the masses until they
hold. A plan that no longer moves satisfies plan = diag(u) exp(-cost/epsilon)
diag(v), the condition of the entropic problem. What is left of the masses'
error is spread as a product measure, so marginals are exact. The start is the
product of the masses; clouds whose points nothing tells apart stay there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The short solver setting (the long one is 200 outer, 50 inner).
SOLVER = {"alpha": 0.5, "epsilon": 0.05, "outer": 60, "inner": 20, "tol": 1e-9}
LOWEST = -300.0  # scores this far below the best of their row and column count as equal


def _padded(batch: pd.DataFrame, side: str, width: int):
    n = len(batch)
    types = np.zeros((n, width), dtype=int)
    mass = np.zeros((n, width))
    dist = np.zeros((n, width, width))
    for row, (t, w, d) in enumerate(zip(batch[f"types_{side}"], batch[f"weights_{side}"], batch[f"dist_{side}"])):
        k = len(t)
        types[row, :k], mass[row, :k] = t, w
        dist[row, :k, :k] = np.stack([np.asarray(x, dtype=float) for x in d])
    positive = dist > 0
    count = positive.sum((1, 2))
    scale = np.where(count > 0, dist.sum((1, 2), where=positive) / np.maximum(count, 1), 1.0)
    return types, mass, dist / scale[:, None, None]


def _ratio(wanted: np.ndarray, found: np.ndarray) -> np.ndarray:
    """wanted / found, 0 at padding (where nothing is wanted)."""
    return wanted / np.where(wanted > 0, found, 1.0)


def _coupling(score: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    """exp(score), scaled to row sums ``a`` and column sums ``b``; padding scores -inf.

    Constants per row or column do not matter to the result, so each row and
    column is first lifted to have 0 as its largest score and nothing vanishes.
    """
    for axis in (2, 1):
        top = score.max(axis, keepdims=True)
        score = score - np.where(np.isfinite(top), top, 0.0)
    kernel = np.where(np.isfinite(score), np.exp(np.maximum(score, LOWEST)), 0.0)
    v = np.ones_like(b)
    for _ in range(rounds):
        reached = np.einsum("pij,pj->pi", kernel, v)
        u = _ratio(a, reached)
        against = np.einsum("pij,pi->pj", kernel, u)
        gap = np.abs(v * against - b).sum(1).max()  # of the plan before its columns are set
        v = _ratio(b, against)
        if gap < tol:
            break
    return u[:, :, None] * kernel * v[:, None, :]


def _settle(plan: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The coupling with exact marginals next to ``plan``."""
    plan = plan * np.minimum(_ratio(a, plan.sum(2)), 1.0)[:, :, None]
    plan = plan * np.minimum(_ratio(b, plan.sum(1)), 1.0)[:, None, :]
    lack_a, lack_b = a - plan.sum(2), b - plan.sum(1)
    total = np.maximum(lack_a.sum(1), np.finfo(float).tiny)
    return plan + lack_a[:, :, None] * lack_b[:, None, :] / total[:, None, None]


def solve(batch: pd.DataFrame, type_cost: np.ndarray, alpha, epsilon, outer, inner, tol):
    """(costs, plans) of all pairs in ``batch``; ``alpha`` is one number per pair.

    Each pair takes steps until its plan moves by less than ``tol``, at most
    ``outer`` of them, each with at most ``inner`` rounds of scaling.
    """
    width = max(max(map(len, batch["types_a"])), max(map(len, batch["types_b"])))
    types_a, a, dist_a = _padded(batch, "a", width)
    types_b, b, dist_b = _padded(batch, "b", width)
    alpha = np.asarray(alpha, dtype=float)[:, None, None]
    tint = (1.0 - alpha) * type_cost[types_a[:, :, None], types_b[:, None, :]]
    # |x - y|^2 = x^2 + y^2 - 2xy, summed under a plan: the squares depend on the masses alone.
    squares = ((dist_a**2) @ a[:, :, None]) + ((dist_b**2) @ b[:, :, None]).transpose(0, 2, 1)

    def linearised(plan, rows):
        return tint[rows] + alpha[rows] * (squares[rows] - 2.0 * (dist_a[rows] @ plan @ dist_b[rows]))

    plans = a[:, :, None] * b[:, None, :]
    moving = np.arange(len(batch))
    for _ in range(outer):
        now = plans[moving]
        with np.errstate(divide="ignore"):
            score = 0.5 * (np.log(now) - linearised(now, moving) / epsilon)
        step = _coupling(score, a[moving], b[moving], inner, tol)
        plans[moving] = step
        moving = moving[np.abs(step - now).sum((1, 2)) >= tol]
        if not len(moving):
            break
    plans = _settle(plans, a, b)
    everything = np.arange(len(batch))
    return np.maximum((linearised(plans, everything) * plans).sum((1, 2)), 0.0), plans


def attach_clouds(pairs: DataFrame, clouds: DataFrame) -> DataFrame:
    side = lambda s: clouds.select(
        F.col("entity").alias(s), F.col("types").alias(f"types_{s}"),
        F.col("weights").alias(f"weights_{s}"), F.col("dist").alias(f"dist_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def fgw_costs(pairs: DataFrame, clouds: DataFrame, type_cost: list[list[float]], **settings) -> DataFrame:
    """Add ``cost``. ``pairs`` may carry its own ``alpha``; other columns pass through."""
    options = SOLVER | settings
    alpha = options.pop("alpha")
    if "alpha" not in pairs.columns:
        pairs = pairs.withColumn("alpha", F.lit(float(alpha)))
    kept = pairs.columns
    table = np.asarray(type_cost)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                costs, _ = solve(batch, table, batch["alpha"], **options)
                yield batch[kept].assign(cost=costs)

    schema = ", ".join(f"{n} {t}" for n, t in pairs.dtypes) + ", cost double"
    return attach_clouds(pairs, clouds).mapInPandas(run, schema)


def fgw_plans(pairs: DataFrame, clouds: DataFrame, type_cost: list[list[float]], **settings) -> DataFrame:
    """(a, b, i, j, mass): the coupling as rows, positions within both clouds."""
    options = SOLVER | settings
    alpha = options.pop("alpha")
    table = np.asarray(type_cost)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            _, plans = solve(batch, table, np.full(len(batch), alpha), **options)
            row, i, j = np.nonzero(plans > 0)
            yield pd.DataFrame({
                "a": batch["a"].to_numpy()[row], "b": batch["b"].to_numpy()[row],
                "i": i, "j": j, "mass": plans[row, i, j]})

    return attach_clouds(pairs.select("a", "b"), clouds).mapInPandas(run, "a long, b long, i int, j int, mass double")
