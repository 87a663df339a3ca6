"""Entropic couplings of tables by alternating updates in the log domain: costs stay a distributed table, whatever their number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .geometry import sinkhorn, unbalanced_coupling
from .lineage import settled

IN_TASK = 1 << 20
"""Costs of a group up to which it is solved within a task; a group of more is solved by rounds over the distributed table."""


def _updated(cost: DataFrame, own: DataFrame, other: DataFrame, by: list[str], mine: str, theirs: str, eps: float, rho: float | None) -> DataFrame:
    """One side's potentials anew: each key's cost rows meet the other side's potentials, and a soft maximum is taken over them.

    The largest exponent of a key is taken off before the sum, by a window over the same rows as the sum: one shuffle."""
    factor = eps if rho is None else rho / (rho + eps) * eps
    x = (F.col("_v") - F.col("c")) / eps
    met = cost.join(other.select(*by, theirs, F.col("v").alias("_v")), [*by, theirs]).select(*by, mine, x.alias("_x"))
    top = F.max("_x").over(Window.partitionBy(*by, mine))
    soft = met.withColumn("_t", top).groupBy(*by, mine).agg((F.max("_t") + F.log(F.sum(F.exp(F.col("_x") - F.col("_t"))))).alias("_s"))
    return own.join(soft, [*by, mine]).select(*by, mine, (factor * (F.log("p") - F.col("_s"))).alias("v"))


def _within_tasks(cost: DataFrame, a: DataFrame, b: DataFrame, eps: float, by: list[str], rho: tuple[float, float] | None) -> DataFrame:
    """Plans of groups of bounded size, each in one task."""
    kinds = dict(cost.dtypes)

    def solve(key, table):
        sides = [np.unique(np.array(table[k].to_pylist(), object), return_index=True, return_inverse=True) for k in ("i", "j")]
        p, q = (table[k].to_numpy()[first] for k, (_, first, _) in zip(("p", "q"), sides, strict=True))
        dense = np.full((len(p), len(q)), np.inf)
        dense[sides[0][2], sides[1][2]] = table["c"].to_numpy()
        plan = sinkhorn(dense, p, q, eps, 100_000, 1e-11) if rho is None else unbalanced_coupling(dense, p, q, eps, *rho, 100_000)
        mass = pa.array(plan[sides[0][2], sides[1][2]])
        return table.select([*by, "i", "j"]).append_column("mass", mass)

    met = cost.join(a, [*by, "i"]).join(b.withColumnRenamed("p", "q"), [*by, "j"]).select(*by, "i", "j", "c", "p", "q")
    return met.groupBy(*by).applyInArrow(solve, ", ".join(f"{c} {kinds[c]}" for c in [*by, "i", "j"]) + ", mass double")


def coupled(cost: DataFrame, a: DataFrame, b: DataFrame, eps: float, by: list[str] | None = None, rho: tuple[float, float] | None = None, tolerance: float = 1e-8, rounds: int = 2000, together: int = 8) -> DataFrame:
    """by, i, j, mass: the plan that minimises cost + eps * mass ln mass, for each group.

    A group of up to ``IN_TASK`` costs is solved in a task; larger ones together, by rounds over all their rows. Both ways end at
    the same plan.

    cost: by, i, j, c (pairs that may not be used are left out); a: by, i, p; b: by, j, p: masses above 0, whose sums agree in a
    group. ``rho``: the prices of leaving a and b, times the relative entropy; without it the plan's sums are a and b. A round is
    two joins with aggregations over the costs; ``together`` rounds run as one job, and the loop ends when a round moves no
    potential by more than ``tolerance``. Raises if it does not within ``rounds``. Keys without costs have no mass.
    """
    if not by:
        whole = [m.withColumn("_all", F.lit(0)) for m in (cost, a, b)]
        return coupled(*whole, eps, ["_all"], rho, tolerance, rounds, together).drop("_all")
    cost = settled(cost.select(*by, "i", "j", F.col("c").cast("double").alias("c")))
    a, b = (settled(m.select(*by, k, F.col("p").cast("double").alias("p"))) for m, k in ((a, "i"), (b, "j")))
    large = settled(cost.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > IN_TASK).select(*by))
    within = _within_tasks(cost.join(large, by, "left_anti"), a, b, eps, by, rho)
    if large.isEmpty():
        return within
    cost, a, b = (settled(m.join(large, by, "left_semi")) for m in (cost, a, b))
    g = b.select(*by, "j", F.lit(0.0).alias("v"))
    for _ in range(0, rounds, together):
        for _ in range(together - 1):  # each update hangs on the one before alone, so the job's plan is a chain
            f = _updated(cost, a, g, by, "i", "j", eps, rho and rho[0])
            g = _updated(cost, b, f, by, "j", "i", eps, rho and rho[1])
        before = settled(f)
        f = settled(_updated(cost, a, _updated(cost, b, before, by, "j", "i", eps, rho and rho[1]), by, "i", "j", eps, rho and rho[0]))
        g = settled(_updated(cost, b, f, by, "j", "i", eps, rho and rho[1]))
        moved = f.join(before.withColumnRenamed("v", "_v"), [*by, "i"]).agg(F.coalesce(F.max(F.abs(F.col("v") - F.col("_v"))), F.lit(0.0))).first()[0]
        if moved <= tolerance:
            break
    else:
        raise ValueError(f"potentials still move by {moved} after {rounds} rounds")
    u, v = f.select(*by, "i", F.col("v").alias("_f")), g.select(*by, "j", F.col("v").alias("_g"))
    return within.unionByName(cost.join(u, [*by, "i"]).join(v, [*by, "j"]).select(*by, "i", "j", F.exp((F.col("_f") + F.col("_g") - F.col("c")) / eps).alias("mass")))
