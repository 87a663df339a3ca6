"""Scoring: distribution distances, rank metrics, tests and composites. Undefined values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import average_rank


def mann_whitney(entries: DataFrame, by: list[str]) -> DataFrame:
    """Two-sided normal test of stage 1 against stage 0 in each group, corrected for ties: u, z, p."""
    rows = entries.withColumn("_r", average_rank("v", by))
    ties = entries.groupBy(*by, "v").agg(F.count("*").alias("_t")).groupBy(*by).agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    g = rows.groupBy(*by).agg(F.sum(F.when(F.col("stage") == 1, F.col("_r")).otherwise(0.0)).alias("_s"), F.count_if(F.col("stage") == 1).alias("n1"), F.count_if(F.col("stage") == 0).alias("n0")).join(ties, by)
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    u = F.col("_s") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12.0 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = (u - n1 * n0 / 2.0) / F.when(sd > 0, sd)
    return g.select(*by, u.alias("u"), z.alias("z"), normal_tail(F.abs(z)).alias("p"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution by the rational approximation 7.1.26 of Abramowitz and Stegun.

    The five coefficients and p are that formula's fixed values.
    """
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.least(poly * F.exp(-x * x), F.lit(1.0))


def step_up(df: DataFrame, by: list[str], p: str, alpha: float, tie: str) -> DataFrame:
    """Benjamini-Hochberg: rows up to the largest k with p_(k) <= alpha k / m are significant."""
    w = Window.partitionBy(*by)
    rows = df.withColumns({"_k": F.row_number().over(w.orderBy(p, tie)), "_m": F.count("*").over(w)})
    last = F.max(F.when(F.round(F.col(p), 12) <= F.round(alpha * F.col("_k") / F.col("_m"), 12), F.col("_k"))).over(w)
    return rows.withColumn("significant", F.col("_k") <= F.coalesce(last, F.lit(0))).drop("_k", "_m")


def overlap_score(overlap: Column, chance: Column) -> Column:
    return F.when(chance < 1, (overlap - chance) / (1 - chance))


def partial_rank_correlation(df: DataFrame, by: list[str], x: str, y: str, given: str) -> DataFrame:
    """Spearman correlation of x and y controlling a third; null where a denominator vanishes."""
    rows = df.withColumns({"_" + n: average_rank(c, by) for n, c in (("x", x), ("y", y), ("g", given))})
    c = rows.groupBy(*by).agg(F.corr("_x", "_y").alias("xy"), F.corr("_x", "_g").alias("xg"), F.corr("_y", "_g").alias("yg"))
    d = F.sqrt((1 - F.col("xg") * F.col("xg")) * (1 - F.col("yg") * F.col("yg")))
    return c.select(*by, F.when(d > 1e-9, (F.col("xy") - F.col("xg") * F.col("yg")) / d).alias("rho"))


def severity_slope(df: DataFrame, by: list[str], pred: str, truth: str, floor: float = 1e-3, least_r2: float = 0.01) -> DataFrame:
    """Slope through the origin of log abs effects, null below an r2."""
    lx, ly = (F.log(F.greatest(F.abs(c), F.lit(floor))) - F.log(F.lit(floor)) for c in (truth, pred))
    rows = df.select(*by, lx.alias("_x"), ly.alias("_y"))
    g = rows.groupBy(*by).agg(F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    r2 = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy")))
    return g.select(*by, F.when(r2 >= least_r2, F.col("xy") / F.col("xx")).alias("slope"), r2.alias("r2"))


def energy_distance(cells: DataFrame, by: str, sample: int) -> DataFrame:
    """2 E|a - b| - E|a - a'| - E|b - b'| between stages, on the first ``sample`` cells of each group and stage by hash.

    The metric is defined on a bounded sample, as pairs grow with its square; each group's sample meets itself in one task.
    """
    import numpy as np
    import pandas as pd

    at = F.row_number().over(Window.partitionBy(by, "stage").orderBy(F.md5(F.col("cell").cast("string")), "cell"))
    s = cells.withColumn("_k", at).where(F.col("_k") <= sample).select(by, "stage", "x")

    def distance(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(v.to_list()) if len(v) else np.zeros((0, 1)) for v in (g[g.stage == k].x for k in (0, 1)))

        def mean(u: np.ndarray, v: np.ndarray, pairs: int) -> float:
            return sum(np.sqrt(((x - v) ** 2).sum(1)).sum() for x in u) / pairs if pairs else float("nan")

        out = 2 * mean(a, b, len(a) * len(b)) - mean(a, a, len(a) * (len(a) - 1)) - mean(b, b, len(b) * (len(b) - 1))
        return pd.DataFrame({by: [g[by].iloc[0]], "energy": [None if np.isnan(out) else float(out)]})

    return s.groupBy(by).applyInPandas(distance, f"{by} {dict(cells.dtypes)[by]}, energy double")


def kernel_distance(a, b, centre, axes, scales: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0)) -> float:
    """Unbiased squared MMD of rows of two arrays in a given frame, over kernels around the second's own median width.

    The width is the median of the squared distances above 0 within ``b``, the truth, alone: like the frame it does not depend
    on what is compared with it.
    """
    import numpy as np

    a, b = (a - centre) @ axes, (b - centre) @ axes
    aa, bb, ab = (np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * u @ v.T, 0) for u, v in ((a, a), (b, b), (a, b)))
    n, m = len(a), len(b)
    within = bb[np.triu_indices(m, 1)]
    width = (np.median(within[within > 0]) if (within > 0).any() else 0.0) + 1e-9
    total = 0.0
    for scale in scales:
        ka, kb, kab = (np.exp(-d * scale / width) for d in (aa, bb, ab))
        total += (ka.sum() - np.trace(ka)) / (n * (n - 1)) + (kb.sum() - np.trace(kb)) / (m * (m - 1)) - 2 * kab.mean()
    return float(total / len(scales))


def variogram_gap(entries: DataFrame, genes: list[int], power: float = 0.5) -> DataFrame:
    """Mean over gene pairs of the squared change between stages of E abs(xi - xj)^power: score and its root."""
    wide = entries.where(F.col("gene").isin(genes)).groupBy("stage", "cell").agg(F.array_sort(F.collect_list(F.struct("gene", "v"))).alias("e"))
    one = wide.select("stage", "e", F.posexplode("e").alias("i", "a")).select("stage", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    rows = one.select("stage", (F.col("a.gene") * 1000 + F.col("b.gene")).alias("pair"), F.pow(F.abs(F.col("a.v") - F.col("b.v")), F.lit(power)).alias("w"))
    g = rows.groupBy("pair").agg(*(F.avg(F.when(F.col("stage") == s, F.col("w"))).alias(f"e{s}") for s in (0, 1)))
    gap = F.avg(F.pow(F.col("e1") - F.col("e0"), 2))
    return g.agg(gap.alias("score"), F.sqrt(gap).alias("root"))


def skill(distance: Column, reference: Column) -> Column:
    """reference / (reference + distance); null where either is unknown or both vanish."""
    total = reference + distance
    return F.when(total > 0, F.least(reference / total, F.lit(1.0)))


def composite(skills: DataFrame, weights: dict[str, float], unit: str, metric: str = "metric", value: str = "skill") -> DataFrame:
    """Weighted mean of 100 * skill, an unknown skill counting 50."""
    w = F.element_at(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))), F.col(metric))
    return skills.withColumn("_w", w).groupBy(unit).agg((F.sum(F.col("_w") * F.coalesce(100 * F.col(value), F.lit(50.0))) / F.sum("_w")).alias("total"))
