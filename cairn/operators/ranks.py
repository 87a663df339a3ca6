"""Ranks, order statistics and transports between distributions. Windows are partitioned by group, never global."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import settled


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 within groups, ties at their average."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2.0


def normalised_rank(value: str, by: list[str]) -> Column:
    """(average rank - 1/2) / n."""
    return (average_rank(value, by) - 0.5) / F.count("*").over(Window.partitionBy(*by))


def effect_score(value: str, by: list[str], tie: str) -> Column:
    """(n - position) / (n + 1) by falling absolute value, the first at position 0."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(value)), tie)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    return (n - at) / (n + 1)


def signed_rank(value: str, by: list[str], df: DataFrame, out: str) -> DataFrame:
    """sign * rank of the absolute value / n."""
    rows = df.withColumn("_a", F.abs(value))
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn(out, F.signum(value) * average_rank("_a", by) / n).drop("_a")


def running_maximum(value: str, by: list[str], order: list[str]) -> Column:
    return F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def arc_length(df: DataFrame, by: list[str], order: list[str], x: str, y: str, out: str = "arc") -> DataFrame:
    """Length along points in order, from the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    return df.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def at_quantile(rows: DataFrame, values: DataFrame, by: list[str], u: str, out: str) -> DataFrame:
    """The quantile function of a group's values ``v`` at u: the i-th of n stands at (i + 1/2) / n, ends are clamped.

    The two values around a place are met by joins on group and rank, so no group is ever held as an array. Rows of groups
    without values go.
    """
    ranked = values.select(*by, "v", (F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1).cast("long").alias("_k"))
    sizes = values.groupBy(*by).agg(F.count("*").alias("_n"))
    at = F.least(F.greatest(F.col(u) * F.col("_n") - 0.5, F.lit(0.0)), (F.col("_n") - 1).cast("double"))
    placed = rows.join(sizes, by).withColumn("_at", at).withColumn("_lo", F.floor("_at")).withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    low, high = (ranked.select(*by, F.col("_k").alias(k), F.col("v").alias(v)) for k, v in (("_lo", "_a"), ("_hi", "_b")))
    met = placed.join(low, [*by, "_lo"]).join(high, [*by, "_hi"])
    return met.withColumn(out, F.col("_a") + (F.col("_at") - F.col("_lo")) * (F.col("_b") - F.col("_a"))).drop("_n", "_at", "_lo", "_hi", "_a", "_b")


def quantile_bridge(entries: DataFrame, lam: float) -> DataFrame:
    """Entries of stage 0 moved to the blend, at their own rank, of the quantile functions of stages 0 and 1."""
    by = ["state", "gene"]
    rows = entries.where("stage = 0").withColumn("u", normalised_rank("v", by))
    rows = at_quantile(rows, entries.where("stage = 0"), by, "u", "_l")
    rows = at_quantile(rows, entries.where("stage = 1"), by, "u", "_r")
    return rows.withColumn("bridged", F.greatest((1 - lam) * F.col("_l") + lam * F.col("_r"), F.lit(0.0))).drop("_l", "_r")


def rank_rebuilt(entries: DataFrame) -> DataFrame:
    """Stage 1's sorted values placed in the order of stage 0's entries, as far as both go."""
    by = Window.partitionBy("state", "gene")
    a = entries.where("stage = 0").withColumn("k", F.row_number().over(by.orderBy("v", "cell")))
    b = entries.where("stage = 1").withColumn("k", F.row_number().over(by.orderBy("v", "cell"))).select("state", "gene", "k", F.col("v").alias("donor"))
    return a.join(b, ["state", "gene", "k"])


def copula_restored(df: DataFrame, by: list[str], own: str, template: str, weight: float, tie: str) -> DataFrame:
    """The group's own values dealt out anew in the order of a blend of own and template ranks; the multiset stays."""
    rows = df.withColumns({"_a": average_rank(own, by), "_b": average_rank(template, by)})
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy((1 - weight) * F.col("_a") + weight * F.col("_b"), tie)))
    values = df.select(*by, F.col(own).alias("restored"), F.row_number().over(Window.partitionBy(*by).orderBy(own, tie)).alias("_k"))
    return rows.join(values, [*by, "_k"]).drop("_a", "_b", "_k")


def occupancy_decoded(entries: DataFrame, factor: float) -> DataFrame:
    """Of each state and gene round(factor * positives) entries stay active: the smallest positives go, zeros of large
    libraries come in at the smallest positive value."""
    by = ["state", "gene"]
    w = Window.partitionBy(*by)
    rows = entries.withColumns({"_p": F.count_if(F.col("v") > 0).over(w), "_n": F.count("*").over(w), "_min": F.min(F.when(F.col("v") > 0, F.col("v"))).over(w)})
    wanted = F.least(F.round(F.col("_p") * factor), F.col("_n"))
    down = F.row_number().over(w.orderBy((F.col("v") > 0).desc(), F.desc("v"), F.desc("library"), "cell"))
    rows = rows.withColumns({"_k": wanted, "_r": down})
    decoded = F.when(F.col("_r") > F.col("_k"), 0.0).when(F.col("v") > 0, F.col("v")).otherwise(F.coalesce("_min", F.lit(0.0)))
    return rows.withColumn("decoded", decoded).drop("_p", "_n", "_min", "_k", "_r")


def mean_rank(df: DataFrame, case: str, metric: str, unit: str, value: str, signs: dict[str, float]) -> DataFrame:
    """Average rank of each unit over cases and metrics; metrics are weighted, a negative weight ranks downwards."""
    sign = F.element_at(F.create_map(*(F.lit(x) for k, s in signs.items() for x in (k, float(s)))), F.col(metric))
    rows = df.withColumns({"_w": F.abs(sign), "_v": F.col(value) * F.signum(sign)})
    rows = rows.withColumn("_r", average_rank("_v", [case, metric]))
    per = rows.groupBy(case, unit).agg((F.sum(F.col("_r") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return per.groupBy(unit).agg(F.avg("_m").alias("rank"), F.count("*").alias("cases"))


def quartile_blocks(df: DataFrame, value: str, by: list[str], out: str = "block") -> DataFrame:
    """0 to 3: how many of the quartiles are at or below the value."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return df.join(q, by).withColumn(out, F.size(F.filter("_q", lambda x: x <= F.col(value))).cast("long")).drop("_q")


def spearman(df: DataFrame, by: list[str], x: str, y: str, average_ties: bool = True, tie: str | None = None) -> DataFrame:
    """Rank correlation; without ``average_ties`` equal values are ranked in order of ``tie``."""
    if average_ties:
        rows = df.withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    else:
        rows = df.withColumns({"_" + n: F.row_number().over(Window.partitionBy(*by).orderBy(c, tie)) for n, c in (("x", x), ("y", y))})
    return rows.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def top_k(df: DataFrame, by: list[str], order: list, k: Column | int, out: str = "position") -> DataFrame:
    """Position in the group; rows beyond the k-th are marked, not dropped."""
    rows = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return rows.withColumn("kept", F.col(out) <= k)


def systematic(df: DataFrame, by: list[str], weight: str, order: list[str], n: int) -> DataFrame:
    """Systematic resampling: of n evenly spread points of the cumulative weight, how many fall on each row."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_c", F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum(weight).over(w))
    below = lambda c: F.least(F.greatest(F.floor(c * n + 0.5), F.lit(0)), F.lit(n))  # noqa: E731  points (i + 1/2) / n before c
    return rows.withColumn("copies", below(F.col("_c") / F.col("_t")) - below((F.col("_c") - F.col(weight)) / F.col("_t"))).drop("_c", "_t")


def normal_quantile(u: Column) -> Column:
    """The inverse normal by the rational approximation 26.2.23 of Abramowitz and Stegun (within 4.5e-4).

    The six coefficients are that formula's fixed values.
    """
    t = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(u < 0.5, -x).otherwise(x)


def row_numbers(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Rows numbered from 0 in an order, by ranges: what is numbered together is a partition, not the table."""
    rows = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # A row for each partition.
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def order_statistics(df: DataFrame, by: list[str], value: str, share: float, places: dict) -> DataFrame:
    """Values of each group at given places of their order, without sorting the group. Nulls do not count.

    places: names, and for each a function of the group's size that gives a place from 1, no less than ``share`` of the size.
    Approximate percentiles bracket the places; values within the bracket are counted and passed in order, all others only
    counted. Rank errors of the percentiles stay below the bracket's margin, whatever the size.
    """
    ends = [max(share - 5e-4, 0.0), *sorted({min(share + d, 1.0) for d in (5e-4, 5e-3, 5e-2)} | {1.0})]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    found = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), 10_000).alias("_p"))
    last = functools.reduce(F.greatest, (f(F.col("_n")) for f in places.values()))
    # The first end that lies beyond the last place, the margin of error taken off.
    high = F.coalesce(*(F.when(F.col("_n") * (e - 1e-4) >= last, F.col("_p")[i]) for i, e in enumerate(ends) if i), F.col("_p")[len(ends) - 1])
    found = settled(found.select(*by, "_n", F.col("_p")[0].alias("_lo"), high.alias("_hi")))
    met = rows.join(found, by).where(F.col("_v") <= F.col("_hi"))
    least = F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v"))  # all below the bracket count as one
    counts = met.groupBy(*by, least.alias("_v")).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    placed = counts.withColumn("_to", F.sum("_c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v"))))
    at = lambda k: F.max(F.when((F.col("_to") - F.col("_c") < k) & (F.col("_to") >= k), F.col("_v")))
    return placed.groupBy(*by).agg(*(at(f(F.col("_n"))).alias(name) for name, f in places.items()))


def medians(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """The exact median of each group: the mean of both middle values."""
    two = order_statistics(df, by, value, 0.5, {"_a": lambda n: F.floor((n + 1) / 2), "_b": lambda n: F.floor(n / 2) + 1})
    return two.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(out))
