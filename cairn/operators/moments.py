"""Grouped moments, shares, quantiles and trends. Variances are of the population unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pseudobulk(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    return entries.groupBy(*(by or []), "gene").agg(F.avg("v").alias("mean"))


def grouped_moments(entries: DataFrame, by: list[str]) -> DataFrame:
    return entries.groupBy(*by, "gene").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count("*").alias("n"))


def sparse_means(nonzero: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Means of a long table that holds non-zero entries alone: sums over the groups' cell counts."""
    sizes = cells.groupBy(*by).agg(F.count("*").alias("n_cells"))
    sums = nonzero.groupBy(*by, "gene").agg(F.sum("v").alias("s"))
    return sums.join(sizes, by).select(*by, "gene", (F.col("s") / F.col("n_cells")).alias("mean"), "n_cells")


def shares(df: DataFrame, by: list[str], within: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Counts (or sums of weights) of groups, and their shares; groups are few, the rows are aggregated first."""
    total = F.count("*") if weight is None else F.sum(weight)
    grouped = df.groupBy(*(within or []), *by).agg(total.alias("n"))
    if within:
        whole = F.sum("n").over(Window.partitionBy(*within))
        return grouped.withColumn("share", F.col("n") / whole)
    whole = grouped.agg(F.sum("n").alias("_n"))
    return grouped.crossJoin(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def smoothed_log_step(before: DataFrame, after: DataFrame, key: str, alpha: float, strength: float, limit: float) -> DataFrame:
    """Clipped log ratio of Dirichlet-smoothed shares. Sides: key, n."""
    both = before.select(key, F.col("n").alias("n0")).join(after.select(key, F.col("n").alias("n1")), key, "full").fillna(0, ["n0", "n1"])
    whole = both.agg(F.sum("n0").alias("sum0"), F.sum("n1").alias("sum1"), F.count("*").alias("K"))
    rows = both.crossJoin(F.broadcast(whole))
    p0, p1 = ((F.col(n) + alpha) / (F.col(big) + alpha * F.col("K")) for n, big in (("n0", "sum0"), ("n1", "sum1")))
    step = F.least(F.greatest(strength * F.log(p1 / p0), F.lit(-limit)), F.lit(limit))
    return rows.select(key, p0.alias("p0"), p1.alias("p1"), step.alias("step"))


def centred_log_ratio(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """log((n + 1/2) / (N + S/2)) after minus before, less its mean over keys."""
    both = before.select(key, F.col("n").alias("n0")).join(after.select(key, F.col("n").alias("n1")), key, "full").fillna(0, ["n0", "n1"])
    whole = both.agg(F.sum("n0").alias("sum0"), F.sum("n1").alias("sum1"), F.count("*").alias("S"))
    rows = both.crossJoin(F.broadcast(whole))
    ratio = F.log((F.col("n1") + 0.5) / (F.col("sum1") + 0.5 * F.col("S"))) - F.log((F.col("n0") + 0.5) / (F.col("sum0") + 0.5 * F.col("S")))
    rows = rows.select(key, ratio.alias("raw"))
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("raw").alias("_m")))).select(key, (F.col("raw") - F.col("_m")).alias("log_ratio"))


def detection(entries: DataFrame, by: list[str]) -> DataFrame:
    """Share of positive entries, and their mean."""
    positive = F.when(F.col("v") > 0, F.col("v"))
    return entries.groupBy(*by).agg((F.count(positive) / F.count("*")).alias("detected"), F.avg(positive).alias("positive_mean"))


def quantile_vector(entries: DataFrame, by: list[str], grid: list[float], least: int = 3) -> DataFrame:
    """Linear quantiles of positive entries; null below ``least`` of them."""
    positive = entries.where("v > 0")
    q = F.percentile("v", F.array(*map(F.lit, grid)))
    return positive.groupBy(*by).agg(F.count("*").alias("n"), q.alias("q")).withColumn("q", F.when(F.col("n") >= least, F.col("q")))


def quantile_response(entries: DataFrame, grid: list[float], prior: float, least: int) -> DataFrame:
    """Per state and gene: quantiles of stage 1 less those of stage 0, shrunk to the response over all states.

    The weight is n / (n + prior), n the smaller count; states below ``least`` on either side abstain.
    """
    q = F.percentile("v", F.array(*map(F.lit, grid)))
    own = entries.groupBy("state", "gene").agg(*(f(s) for s in (0, 1) for f in (lambda s: F.percentile(F.when(F.col("stage") == s, F.col("v")), F.array(*map(F.lit, grid))).alias(f"q{s}"), lambda s: F.count(F.when(F.col("stage") == s, 1)).alias(f"n{s}"))))
    pooled = entries.where("stage = 0").groupBy("gene").agg(q.alias("g0")).join(entries.where("stage = 1").groupBy("gene").agg(q.alias("g1")), "gene")
    n = F.least("n0", "n1")
    weight = n / (n + prior)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: y - x)
    blend = F.zip_with(minus("q0", "q1"), minus("g0", "g1"), lambda a, b: weight * a + (1 - weight) * b)
    return own.join(pooled, "gene").where(n >= least).select("state", "gene", weight.alias("weight"), blend.alias("response"))


def robust_spread(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """1.4826 MAD, else IQR / 1.349, else the standard deviation: the first that is positive."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    first = df.groupBy(*by).agg(q.alias("q"), F.stddev_pop(value).alias("sd"))
    mad = df.join(first, by).groupBy(*by).agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("q")[1]), F.lit(0.5))).alias("mad"))
    iqr = (F.col("q")[2] - F.col("q")[0]) / 1.349
    spread = F.when(F.col("mad") > 0, F.col("mad")).when(iqr > 0, iqr).otherwise(F.col("sd"))
    return first.join(mad, by).select(*by, F.col("q")[1].alias("median"), "mad", iqr.alias("iqr_sd"), spread.alias("spread"))


def collapsed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Duplicate keys become their mean; how many rows were collapsed."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.count("*") - 1).alias("collapsed"))


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    return df.groupBy(*inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("mean"), F.count("*").alias("n_inner"))


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample standard deviation, and the mean rounded to the digits that the deviation warrants."""
    rows = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))
    digits = F.when(F.col("sd") >= 10, 0).when(F.col("sd") >= 1, 1).when(F.col("sd") >= 0.1, 2).otherwise(3)
    shown = F.when(digits == 0, F.round("mean", 0)).when(digits == 1, F.round("mean", 1)).when(digits == 2, F.round("mean", 2)).otherwise(F.round("mean", 3))
    return rows.select(*by, "mean", "sd", "n", digits.alias("digits"), shown.alias("shown"))


def pair_correlation(entries: DataFrame, genes: list[int], by: list[str]) -> DataFrame:
    """Correlation and covariance of gene pairs over cells, and the mean of sqrt(abs(difference)), in one pass per group.

    The genes are named, so pairs are columns of one pivoted row per cell and no pair of cells is formed.
    """
    wide = entries.where(F.col("gene").isin(genes)).groupBy(*by, "cell").pivot("gene", genes).agg(F.first("v"))
    pairs = [(a, b) for i, a in enumerate(genes) for b in genes[i + 1 :]]
    parts = [F.struct(F.lit(a).alias("gene_a"), F.lit(b).alias("gene_b"), F.col(str(a)).alias("x"), F.col(str(b)).alias("y")) for a, b in pairs]
    rows = wide.select(*by, F.explode(F.array(*parts)).alias("p")).select(*by, "p.*")
    return rows.groupBy(*by, "gene_a", "gene_b").agg(F.corr("x", "y").alias("corr"), F.covar_pop("x", "y").alias("cov"), F.avg(F.sqrt(F.abs(F.col("x") - F.col("y")))).alias("root_gap"))


def trend_at(df: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """Least-squares line at a point."""
    rows = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return rows.withColumn("at", F.col("slope") * at + F.col("intercept"))


def lagrange(values: list[Column], times: list[float], at: float) -> Column:
    """The parabola through three points, at a fourth."""
    a, b, c = times
    weight = [(at - b) * (at - c) / ((a - b) * (a - c)), (at - a) * (at - c) / ((b - a) * (b - c)), (at - a) * (at - b) / ((c - a) * (c - b))]
    return values[0] * weight[0] + values[1] * weight[1] + values[2] * weight[2]
