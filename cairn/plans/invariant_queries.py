"""What results without a closed form must keep, as queries that SQL can state: distances, means and multisets over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import geometry

from .registry import EXPR, POINTS, Tables, query, r
from .solver_queries import blended
from .transform_queries import a29_a30_position_ridge


@query(f"WITH {POINTS}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) + var_pop(y) + var_pop(z) AS v FROM points) SELECT cell, round((pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)) / v, 4) + 0.0 AS square FROM points, m")
def g2_canonical_radii(t: Tables) -> DataFrame:
    """A canonical cloud keeps how far each point is from the middle, against the cloud's radius."""
    return geometry.canonical(t.points()).select("cell", r(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"), 4).alias("square"))


@query(f"WITH {POINTS}, s AS (SELECT state, count(*) FILTER (stage = 0) AS n0, count(*) FILTER (stage = 1) AS n1, avg(x) FILTER (stage = 0) AS x, avg(y) FILTER (stage = 0) AS y, avg(z) FILTER (stage = 0) AS z FROM points GROUP BY 1), w AS (SELECT *, 2 / (1.0 / n0 + 1.0 / n1) AS w FROM s WHERE n0 > 0 AND n1 > 0), c AS (SELECT sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz FROM w) SELECT cell, round(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2), 6) + 0.0 AS square FROM points, c WHERE stage = 0")
def g4_procrustes_distances(t: Tables) -> DataFrame:
    """A rigid motion keeps how far each point is from the centre that is moved."""
    p = t.points()
    origin, turn, goal = geometry.procrustes(p.where("stage = 0"), p.where("stage = 1"), "state")
    moved = geometry.transformed(p.where("stage = 0"), origin, turn, goal)
    return moved.select("cell", r(sum((F.pow(F.col(c) - float(g), 2) for c, g in zip("xyz", goal, strict=True)), F.lit(0.0))).alias("square"))


@query(f"WITH {EXPR} SELECT state, gene, round(avg(v), 6) + 0.0 AS mean FROM expr GROUP BY ALL")
def a29_a30_fitted_means(t: Tables) -> DataFrame:
    """A fit with a free constant has the mean of what it was fitted to."""
    m = t.points().groupBy("state").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    fit = F.col("w0") + sum((F.col(f"w{c}") * F.col(f"m{c}") for c in "xyz"), F.lit(0.0))
    return a29_a30_position_ridge(t).join(m, "state").select("state", "gene", r(fit).alias("mean"))


@query(f"WITH {EXPR} SELECT state, gene, count(*) AS n, round(sum(v), 4) + 0.0 AS total, round(sum(v * v), 4) + 0.0 AS squares, round(max(v), 6) + 0.0 AS top FROM expr GROUP BY ALL")
def y23_blended_multisets(t: Tables) -> DataFrame:
    """Dealing values out anew keeps the values of each state and gene."""
    v = F.col("restored")
    return blended(t).groupBy("state", "gene").agg(F.count("*").alias("n"), r(F.sum(v), 4).alias("total"), r(F.sum(v * v), 4).alias("squares"), r(F.max(v)).alias("top"))
