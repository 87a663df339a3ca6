"""Labels spread over neighbour graphs, by conjugate gradients on distributed edge and vector tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import neighbours
from .lineage import settled
from .ranks import medians


def neighbour_graph(points: DataFrame, k: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Symmetric edges src, dst, w of the k nearest of each point within its group, and each group's ``scale``.

    A neighbour at distance d weighs exp(-min((d / scale)^2, 700)); the scale is the group's median distance above 0 (1 where
    there is none, 1e-6 at least). An edge's weight is the mean of both directions, one that is missing counting 0.
    """
    near = settled(neighbours(points, k, by).select(*by, "src", "dst", "dist"))
    scale = medians(near.where("dist > 0"), by, "dist", "scale").withColumn("scale", F.greatest("scale", F.lit(1e-6)))
    scale = points.select(*by).distinct().join(scale, by, "left").fillna(1.0, ["scale"])
    w = F.exp(-F.least(F.pow(F.col("dist") / F.col("scale"), 2), F.lit(700.0))) / 2
    half = near.join(scale, by).select("src", "dst", w.alias("w"))
    both = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w")), scale


def propagated(nodes: DataFrame, edges: DataFrame, alpha: float, tolerance: float = 1e-10, rounds: int = 2000) -> DataFrame:
    """cell, f: the solution of f = alpha D^-1 W f + (1 - alpha) y; a node without edges keeps its y.

    nodes: cell, y; edges: src, dst, w, in both directions with equal weights. The system is solved in its symmetric form by
    conjugate gradients: a round is one join of the edges with the vector, one sum by node and one row of dot products.
    Raises if the residual has not fallen to ``tolerance`` times that of the start within ``rounds``.
    """
    degree = edges.groupBy("src").agg(F.sum("w").alias("degree"))
    nodes = settled(nodes.select("cell", F.col("y").cast("double").alias("y")).join(degree.withColumnRenamed("src", "cell"), "cell", "left").fillna(0.0, ["degree"]))
    root = nodes.where("degree > 0").select("cell", F.sqrt(F.greatest("degree", F.lit(1e-12))).alias("s"))
    a, b = (root.select(F.col("cell").alias(c), F.col("s").alias(f"s_{c}")) for c in ("src", "dst"))
    step = settled(edges.join(a, "src").join(b, "dst").select("src", "dst", (alpha * F.col("w") / (F.col("s_src") * F.col("s_dst"))).alias("w")))
    start = nodes.where("degree > 0").select("cell", ((1 - alpha) * F.sqrt(F.greatest("degree", F.lit(1e-12))) * F.col("y")).alias("r"))
    at = start.select("cell", F.lit(0.0).alias("x"), "r", F.col("r").alias("p"))
    first = left = start.agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).first()[0]
    for _ in range(rounds):
        if left <= tolerance * tolerance * first or first == 0:
            break
        moved = step.join(at.select(F.col("cell").alias("dst"), "p"), "dst").groupBy(F.col("src").alias("cell")).agg(F.sum(F.col("w") * F.col("p")).alias("m"))
        at = settled(at.join(moved, "cell", "left").select("cell", "x", "r", "p", (F.col("p") - F.coalesce("m", F.lit(0.0))).alias("q")))
        dots = at.agg(*(F.sum(F.col(u) * F.col(v)).alias(u + v) for u, v in ("pq", "rq", "qq", "rr"))).first()
        size = dots["rr"] / dots["pq"]
        now = max(dots["rr"] - 2 * size * dots["rq"] + size * size * dots["qq"], 0.0)
        # The recurrence for the residual's square cancels near the end, so it only steers; below it is taken anew.
        at = at.select("cell", (F.col("x") + size * F.col("p")).alias("x"), (F.col("r") - size * F.col("q")).alias("r"), "p")
        if now <= 1e-10 * dots["rr"] or not math.isfinite(now):
            now = at.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        at, left = at.withColumn("p", F.col("r") + now / dots["rr"] * F.col("p")), now
    else:
        raise ValueError(f"residual {math.sqrt(left)} after {rounds} rounds")
    found = nodes.join(at.select("cell", "x"), "cell", "left")
    return found.select("cell", F.when(F.col("degree") > 0, F.col("x") / F.sqrt(F.greatest("degree", F.lit(1e-12)))).otherwise(F.col("y")).alias("f"))


def propagated_rounds(nodes: DataFrame, edges: DataFrame, alpha: float, rounds: int, apart: float = 1e-15) -> DataFrame:
    """cell, f: what ``rounds`` steps f <- alpha D^-1 W f + (1 - alpha) y from f = y come to; a node without edges keeps its y.

    Not the limit of ``propagated``: from that it is alpha ** rounds away, which may turn a rounded digit. The steps' polynomial in
    D^-1 W, whose eigenvalues are within -1 and 1, is taken by Chebyshev's terms up to those that stay below ``apart``: a term is one join of
    the edges with the vector and one sum by node, and there are fewer terms than rounds.
    """
    series = np.polynomial.chebyshev.chebinterpolate(lambda s: (1 - alpha) * sum((alpha * s) ** k for k in range(rounds)) + (alpha * s) ** rounds, rounds)
    last = max(int(np.flatnonzero(np.abs(series) > apart).max(initial=0)), 1)
    degree = edges.groupBy("src").agg(F.sum("w").alias("degree"))
    step = settled(edges.join(degree, "src").where("degree > 0").select("src", "dst", (F.col("w") / F.col("degree")).alias("w")))
    nodes = settled(nodes.select("cell", F.col("y").cast("double").alias("y")))
    known = nodes.join(step.select(F.col("src").alias("cell")).distinct(), "cell", "left_semi")

    def moved(at: DataFrame, c: str) -> DataFrame:
        return step.join(at.select(F.col("cell").alias("dst"), F.col(c).alias("v")), "dst").groupBy(F.col("src").alias("cell")).agg(F.sum(F.col("w") * F.col("v")).alias("m"))

    # a, b: the terms before; f: the sum so far.
    at = known.join(moved(known, "y"), "cell", "left").select("cell", F.col("y").alias("a"), F.coalesce("m", F.lit(0.0)).alias("b"))
    at = settled(at.withColumn("f", float(series[0]) * F.col("a") + float(series[1]) * F.col("b")))
    for k in range(2, last + 1):
        new = 2 * F.coalesce("m", F.lit(0.0)) - F.col("a")
        at = settled(at.join(moved(at, "b"), "cell", "left").select("cell", F.col("b").alias("a"), new.alias("b"), (F.col("f") + float(series[k]) * new).alias("f")))
    return nodes.join(at.select("cell", "f"), "cell", "left").select("cell", F.coalesce("f", "y").alias("f"))


def residual(nodes: DataFrame, edges: DataFrame, solution: DataFrame, alpha: float) -> float:
    """The length of f - alpha D^-1 W f - (1 - alpha) y over nodes with edges."""
    f = solution.select(F.col("cell").alias("dst"), F.col("f").alias("g"))
    mean = edges.join(f, "dst").groupBy(F.col("src").alias("cell")).agg((F.sum(F.col("w") * F.col("g")) / F.sum("w")).alias("m"))
    gap = F.col("f") - alpha * F.col("m") - (1 - alpha) * F.col("y")
    return nodes.join(solution, "cell").join(mean, "cell").agg(F.sqrt(F.coalesce(F.sum(gap * gap), F.lit(0.0)))).first()[0]
