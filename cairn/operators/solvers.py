"""Solvers for small groups: couplings of structures, pairings by swaps, rigid registration, ridge fields.

Each works on arrays of one state, or on one aggregated table; groups are sampled to a stated size before they come here.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import SquaredGaps, assignment, first_gaps, sinkhorn


def fused_coupling(cost: np.ndarray, c1: np.ndarray, c2: np.ndarray, p: np.ndarray, q: np.ndarray, alpha: float, eps: float, rounds: int = 50) -> np.ndarray:
    """Entropic fused Gromov-Wasserstein plan: the structure term is linearised at the present plan, then coupled anew."""
    plan = np.outer(p, q)
    square = (c1**2 @ p)[:, None] + (c2**2 @ q)[None]
    for _ in range(rounds):
        gradient = (1 - alpha) * cost + 2 * alpha * (square - 2 * c1 @ plan @ c2.T)
        new = sinkhorn(gradient, p, q, eps)
        if np.abs(new - plan).max() < 1e-9:
            return new
        plan = new
    return plan


def fused_loss(plan: DataFrame, cost: DataFrame, c1: DataFrame, c2: DataFrame, alpha: float) -> DataFrame:
    """linear, structure and total loss of a plan, by joins over state pairs: plan (i, j, mass), cost (i, j, c), c1 (i, k, c), c2 (j, l, c).

    With square loss the fourfold sum is sum c1^2 p p + sum c2^2 q q - 2 sum (c1 T c2) T, T the plan.
    """
    p = plan.groupBy("i").agg(F.sum("mass").alias("m"))
    q = plan.groupBy("j").agg(F.sum("mass").alias("m"))

    def own(c: DataFrame, a: str, b: str, w: DataFrame, key: str) -> DataFrame:
        left, right = (w.select(F.col(key).alias(n), F.col("m").alias(f"m_{n}")) for n in (a, b))
        return c.join(left, a).join(right, b).agg(F.sum(F.col("c") * F.col("c") * F.col(f"m_{a}") * F.col(f"m_{b}")).alias("s"))

    moved = c1.join(plan.select(F.col("i").alias("k"), F.col("j").alias("l"), "mass"), "k").groupBy("i", "l").agg(F.sum(F.col("c") * F.col("mass")).alias("a"))
    inner = moved.join(c2.withColumnRenamed("c", "d"), "l").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("d")).alias("b"))
    cross = inner.join(plan, ["i", "j"]).agg(F.sum(F.col("b") * F.col("mass")).alias("x"))
    linear = plan.join(cost, ["i", "j"]).agg(F.sum(F.col("mass") * F.col("c")).alias("linear"))
    parts = linear.crossJoin(own(c1, "i", "k", p, "i").withColumnRenamed("s", "s1")).crossJoin(own(c2, "j", "l", q, "j").withColumnRenamed("s", "s2")).crossJoin(cross)
    structure = F.col("s1") + F.col("s2") - 2 * F.col("x")
    return parts.select("linear", structure.alias("structure"), ((1 - alpha) * F.col("linear") + alpha * structure).alias("total"))


def swapped_pairing(z: np.ndarray, desired: np.ndarray, graph: np.ndarray, proposals: int = 8) -> np.ndarray:
    """Which row stands at each node after one pass of swaps, nodes by falling residual, each strict gain taken.

    The residual of a node is the squared gap between the mean of its graph neighbours' rows and what its own row desires.
    """
    at = np.arange(len(z))
    # The nodes whose mean a node's row enters, one after the other.
    rows, places = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    order = np.argsort(places, kind="stable")
    enters, edges = rows[order], np.searchsorted(places[order], np.arange(len(z) + 1))
    place = at.copy()  # where a row stands

    def residuals(nodes: np.ndarray) -> np.ndarray:
        return ((z[at[graph[nodes]]].mean(1) - desired[at[nodes]]) ** 2).sum(1)

    near = _others(z, proposals)
    start = residuals(at)
    total = start.sum()
    for node in np.argsort(-start, kind="stable"):
        best, change = -1e-12 * max(1.0, total), None
        for row in near[at[node]]:
            other = int(place[row])
            touched = np.unique(np.concatenate([enters[edges[node] : edges[node + 1]], enters[edges[other] : edges[other + 1]], [node, other]]))
            before = residuals(touched).sum()
            at[[node, other]] = at[[other, node]]
            if (gain := residuals(touched).sum() - before) < best:
                best, change = gain, other
            at[[node, other]] = at[[other, node]]
        if change is not None:
            at[[node, change]] = at[[change, node]]
            place[at[[node, change]]] = [node, change]
            total += best
    return at


def _others(z: np.ndarray, k: int) -> np.ndarray:
    """Each row's nearest, less the first of them, which is the row itself or its equal."""
    return first_gaps(z, z, k + 1)[:, 1:]


def rigid_em(x: np.ndarray, y: np.ndarray, rounds: int = 40, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that carry points x on y: soft correspondences, then the weighted proper rotation, in turn.

    About ``held`` correspondences are held at a time."""
    if not len(x) or not len(y):
        return np.eye(x.shape[1]), np.zeros(x.shape[1])
    turn, origin = np.eye(x.shape[1]), y.mean(0)
    y = y - origin  # squares are sums of products below
    shift = -x.mean(0)
    square, step = (y * y).sum(1), max(1, held // len(y))

    def met(at: np.ndarray, var: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the mean of ``y`` and of its squares, by how well they correspond; some rows at a time."""
        goal, spread = np.empty_like(at), np.empty(len(at))
        for lo in range(0, len(at), step):
            w = (at[lo : lo + step] @ y.T - square / 2) / var
            w = np.exp(w - w.max(1, keepdims=True))
            w /= w.sum(1, keepdims=True)
            goal[lo : lo + step], spread[lo : lo + step] = w @ y, w @ square
        return goal, spread

    moved = x + shift
    var = ((moved * moved).sum(1).mean() + square.mean() - 2 * moved.mean(0) @ y.mean(0)) / x.shape[1]
    for _ in range(rounds):
        goal, spread = met(x @ turn + shift, max(var, 1e-300))
        cx, cy = x.mean(0), goal.mean(0)
        u, _, vt = np.linalg.svd((x - cx).T @ (goal - cy))
        u[:, -1] *= np.sign(np.linalg.det(u @ vt))
        turn = u @ vt
        shift = cy - cx @ turn
        moved = x @ turn + shift
        var = max(float(((moved * moved).sum(1) + spread - 2 * (moved * goal).sum(1)).mean()) / x.shape[1], 1e-6)
    return turn, shift + origin


def quadratic(points: np.ndarray) -> np.ndarray:
    """1, the coordinates, their squares and products."""
    i, j = np.triu_indices(points.shape[1])
    return np.column_stack([np.ones(len(points)), points, points[:, i] * points[:, j]])


def ridge(x: np.ndarray, y: np.ndarray, strength: float) -> np.ndarray:
    """Coefficients with an unpenalised first column."""
    penalty = strength * len(x) * np.eye(x.shape[1])
    penalty[0, 0] = 0
    return np.linalg.solve(x.T @ x + penalty, x.T @ y)


def rewired(points: np.ndarray, scores: np.ndarray, left: tuple, right: tuple, t: float) -> np.ndarray:
    """A permutation of rows over fixed points: scores are assigned to what ridge fields of both stages, blended, expect.

    left, right: (points, scores) of a stage.
    """
    fields = [ridge(quadratic(p), s, 0.01) for p, s in (left, right)]
    expected = quadratic(points) @ ((1 - t) * fields[0] + t * fields[1])
    scaled = lambda v: (v - v.mean(0)) / np.maximum(v.std(0), 1e-9)
    return assignment(SquaredGaps(scaled(expected), scaled(scores)))


def counterfactual(df: DataFrame, target: str, value: float, models: dict[str, dict[str, float]]) -> DataFrame:
    """Sets one column and lets the change pass through linear models in topological order; residuals stay as observed."""
    change: dict[str, Column] = {target: F.lit(value) - F.col(target)}
    for node, parents in models.items():
        change[node] = sum((change[p] * w for p, w in parents.items() if p in change), F.lit(0.0))
    return df.withColumns({c: F.col(c) + d for c, d in change.items()})
