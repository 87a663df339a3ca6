"""Fits with closed forms, sampling by depth, programs and emitters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .alloc import hash_order


def depth_matched(df: DataFrame, side: str, value: str, ident: str, bins: int, seed: int) -> DataFrame:
    """Of each bin of pooled quantiles as many rows from both sides as the smaller has, in random order."""
    grid = [F.lit(i / bins) for i in range(1, bins)]
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*grid))).alias("_e"))
    rows = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col(value)))).drop("_e")
    sizes = rows.groupBy("bin").agg(*(F.count_if(F.col(side) == s).alias(f"_{s}") for s in (0, 1))).select("bin", F.least("_0", "_1").alias("_k"))
    at = F.row_number().over(Window.partitionBy("bin", side).orderBy(hash_order(seed, ident), ident))
    return rows.join(sizes, "bin").withColumn("_r", at).where(F.col("_r") <= F.col("_k")).drop("_r", "_k")


def sparsified(df: DataFrame, by: list[str], value: str, k: int, tie: str) -> DataFrame:
    """The k largest positive and k smallest negative values of a group stay, others become 0."""
    w = Window.partitionBy(*by)
    up, down = F.row_number().over(w.orderBy(F.desc(value), tie)), F.row_number().over(w.orderBy(value, tie))
    rows = df.withColumns({"_u": up, "_d": down})
    keep = (F.col("_u") <= k) & (F.col(value) > 0) | (F.col("_d") <= k) & (F.col(value) < 0)
    return rows.withColumn("sparse", F.when(keep, F.col(value)).otherwise(0.0)).drop("_u", "_d")


def demeaned_slope(df: DataFrame, within: str, x: str, y: str, least: int, by: list[str]) -> DataFrame:
    """Pooled slope of y on x after removing the means of large groups; 0 where x hardly varies."""
    m = df.groupBy(*by, within).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    rows = df.join(m, [*by, within])
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    g = rows.groupBy(*by).agg(F.sum(dx * dy).alias("_xy"), F.sum(dx * dx).alias("_xx"))
    return g.select(*by, F.when(F.col("_xx") > 1e-12, F.col("_xy") / F.col("_xx")).otherwise(0.0).alias("slope"))


def residual_calibration(df: DataFrame, within: str, x: str, y: str, ridge: float, train: str) -> DataFrame:
    """Per group mean of y and a ridge slope of y on x, within 0 and 1, from training rows; absent groups take the overall."""
    rows = df.where(train)
    fit = lambda g: g.agg(F.avg(y).alias("mean"), (F.sum((F.col(x)) * F.col(y)) / (F.sum(F.col(x) * F.col(x)) + ridge)).alias("slope"))
    own, pooled = fit(rows.groupBy(within)), fit(rows.groupBy())
    out = df.select(within).distinct().join(own, within, "left").crossJoin(F.broadcast(pooled.select(F.col("mean").alias("_m"), F.col("slope").alias("_s"))))
    slope = F.least(F.greatest(F.coalesce("slope", "_s"), F.lit(0.0)), F.lit(1.0))
    return out.select(within, F.coalesce("mean", "_m").alias("mean"), slope.alias("slope"))


def tempered(shares: DataFrame, p: str, q: str, strength: float) -> DataFrame:
    """p moved towards q in log space and renormalised: p exp(strength ln(q / p)). A row for each key."""
    rows = shares.withColumn("_x", F.col(p) * F.exp(strength * F.log(F.col(q) / F.col(p))))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("_x").alias("_s")))).withColumn("tempered", F.col("_x") / F.col("_s")).drop("_x", "_s")


def program_scores(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Per cell and program the mean-centred ranks of its genes, weighted. weights: program, gene, weight."""
    from .ranks import average_rank

    n = F.count("*").over(Window.partitionBy("cell"))
    ranked = entries.withColumn("_r", average_rank("v", ["cell"]) / n - (n + 1) / (2 * n))
    rows = ranked.join(weights, "gene")
    return rows.groupBy("cell", "program").agg((F.sum(F.col("_r") * F.col("weight")) / F.sum(F.abs("weight"))).alias("score"))


def shrunk_covariance(c: np.ndarray, s: float) -> np.ndarray:
    return (1 - s) * c + s * np.trace(c) / len(c) * np.eye(len(c))


def to_correlation(c: np.ndarray) -> np.ndarray:
    d = 1 / np.sqrt(np.diag(c))
    return c * d[:, None] * d[None]


def estimated_covariance(rows: DataFrame, x: str, size: int) -> tuple[np.ndarray, float]:
    """Covariance (divided by n) of arrays of ``size`` numbers, and how far to shrink it towards its mean variance.

    The share is that of the sampling noise in what sets the covariance apart from the target (Ledoit and Wolf). Sums are made
    in tasks; what reaches the driver is a square of ``size`` numbers.
    """
    import pandas as pd

    n, *means = rows.agg(F.count("*"), *(F.avg(F.get(F.col(x), F.lit(i))) for i in range(size))).first()
    centre = np.array([m or 0.0 for m in means], float)

    def sums(batches):
        total = np.zeros(size * size + 1)
        for b in batches:
            if len(b):
                d = np.stack(b[x].to_list()) - centre
                total[:-1] += (d.T @ d).ravel()
                total[-1] += ((d * d).sum(1) ** 2).sum()
        yield pd.DataFrame({"place": np.arange(len(total)), "v": total})

    out = np.zeros(size * size + 1)
    for r in rows.select(x).mapInPandas(sums, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r["place"]] = r["v"]
    c = out[:-1].reshape(size, size) / max(n, 1)
    apart = ((c - np.eye(size) * np.trace(c) / size) ** 2).sum()
    noise = (out[-1] / max(n, 1) - (c * c).sum()) / max(n, 1)
    return c, float(np.clip(noise / apart, 0, 1)) if apart > 0 else 1.0
