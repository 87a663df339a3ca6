"""Shifts between stages, trends and extrapolations, centroids and radii. Group statistics are small and joined to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matrix import to_long, unit_rows


def _two_stages(entries: DataFrame, by: list[str], f=F.avg, names: tuple[str, str] = ("m0", "m1")) -> DataFrame:
    return entries.groupBy(*by).agg(*(f(F.when(F.col("stage") == s, F.col("v"))).alias(n) for s, n in enumerate(names)))


def stage_shift(entries: DataFrame) -> DataFrame:
    """Rows of stage 1 moved by their state's and gene's change from stage 0 to 1, none where a side is absent; never below 0."""
    delta = _two_stages(entries, ["state", "gene"]).select("state", "gene", F.coalesce(F.col("m1") - F.col("m0"), F.lit(0.0)).alias("d"))
    rows = entries.where("stage = 1").join(delta, ["state", "gene"])
    return rows.withColumn("v", F.greatest(F.col("v") + F.col("d"), F.lit(0.0))).drop("d")


def damped_shift(entries: DataFrame, damp: float, weight: float) -> DataFrame:
    """As ``stage_shift`` by damp times a mixture of the state's and the overall change; absent states take the overall one."""
    own = _two_stages(entries, ["state", "gene"])
    pooled = _two_stages(entries, ["gene"], names=("g0", "g1"))
    g = F.col("g1") - F.col("g0")
    delta = own.join(pooled, "gene").select("state", "gene", (damp * (weight * F.coalesce(F.col("m1") - F.col("m0"), g) + (1 - weight) * g)).alias("d"))
    rows = entries.where("stage = 1").join(delta, ["state", "gene"])
    return rows.withColumn("v", F.greatest(F.col("v") + F.col("d"), F.lit(0.0))).drop("d")


def median_extrapolated(entries: DataFrame, damp: float, factor: float) -> DataFrame:
    """Rows of stage 1 moved on by the change of medians, damped and scaled by the time factor."""
    delta = _two_stages(entries, ["state", "gene"], lambda v: F.percentile(v, F.lit(0.5))).select("state", "gene", (damp * factor * (F.col("m1") - F.col("m0"))).alias("d"))
    rows = entries.where("stage = 1").join(delta.where("d is not null"), ["state", "gene"])
    return rows.withColumn("v", F.greatest(F.col("v") + F.col("d"), F.lit(0.0))).drop("d")


def centroids(cells: DataFrame) -> DataFrame:
    """Per state the mean of unit rows, at length 1."""
    rows = to_long(cells.withColumn("x", unit_rows(F.col("x")))).groupBy("state", "gene").agg(F.avg("v").alias("v"))
    wide = rows.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("gene", "v"))).alias("r"))
    return wide.select("state", unit_rows(F.transform("r", lambda p: p["v"])).alias("centroid"))


def rms_radius(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rms"))


def log_share_trend(df: DataFrame, key: str, time: str, at: float, last, fold: float) -> DataFrame:
    """Log-linear trend of each key's share over time, at a later time, within a fold of the last share; renormalised."""
    counts = df.groupBy(key, time).agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(time)))
    fit = p.groupBy(key).agg((F.regr_slope(F.log("p"), F.col(time).cast("double")) * at + F.regr_intercept(F.log("p"), F.col(time).cast("double"))).alias("l"), F.max(F.when(F.col(time) == last, F.col("p"))).alias("ref"))
    bounded = fit.select(key, F.least(F.greatest(F.exp("l"), F.col("ref") / fold), F.col("ref") * fold).alias("x"))
    return _normalised(bounded, key)


def extrapolated_shares(before: DataFrame, after: DataFrame, key: str, floor: float) -> DataFrame:
    """Shares carried on by their last change, at least ``floor``; keys unseen before keep their share; renormalised."""
    both = before.select(key, F.col("n").alias("n0")).join(after.select(key, F.col("n").alias("n1")), key, "full").fillna(0, ["n0", "n1"])
    whole = both.agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
    p0, p1 = F.col("n0") / F.col("s0"), F.col("n1") / F.col("s1")
    rows = both.crossJoin(F.broadcast(whole)).select(key, F.when(p0 == 0, p1).otherwise(F.greatest(F.lit(floor), 2 * p1 - p0)).alias("x"))
    return _normalised(rows, key)


def _normalised(rows: DataFrame, key: str) -> DataFrame:
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("x").alias("_s")))).select(key, (F.col("x") / F.col("_s")).alias("share"))


def state_gates(entries: DataFrame, gene: int) -> DataFrame:
    """Mean of one gene by state over its maximum, within 0 and 1."""
    m = entries.where(F.col("gene") == gene).groupBy("state").agg(F.avg("v").alias("m"))
    return m.crossJoin(F.broadcast(m.agg(F.max("m").alias("top")))).select("state", F.least(F.greatest(F.col("m") / F.col("top"), F.lit(0.0)), F.lit(1.0)).alias("gate"))
