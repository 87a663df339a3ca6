"""Further transports between distributions, composition forecasts, graph layers and neighbour smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import at_quantile, row_numbers


def positive_transport(entries: DataFrame, grid: list[float], limit: float) -> DataFrame:
    """Positive entries of stage 0 moved by the step of log quantiles to stage 1, interpolated at their own level.

    Per state and gene the quantiles of both stages at the grid are knots; the step is bounded.
    """
    q = lambda s: F.percentile(F.when((F.col("stage") == s) & (F.col("v") > 0), F.col("v")), F.array(*map(F.lit, grid))).alias(f"q{s}")
    knots = entries.groupBy("state", "gene").agg(q(0), q(1)).where("q0 is not null and q1 is not null")
    step = F.zip_with("q0", "q1", lambda a, b: F.least(F.greatest(F.log(b / a), F.lit(-limit)), F.lit(limit)))
    rows = entries.where("stage = 0 and v > 0").join(knots.withColumn("step", step), ["state", "gene"])
    low = F.greatest(F.size(F.filter("q0", lambda x: x <= F.col("v"))) - 1, F.lit(0))
    high = F.least(low + 1, F.lit(len(grid) - 1))
    a, b = F.get("q0", low), F.get("q0", high)
    part = F.when(b > a, F.least(F.greatest((F.col("v") - a) / (b - a), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    move = F.get("step", low) + part * (F.get("step", high) - F.get("step", low))
    return rows.withColumn("moved", F.col("v") * F.exp(move)).drop("q0", "q1", "step")


def zero_aware_transport(entries: DataFrame) -> DataFrame:
    """Entries of stage 0 at the quantile function of stage 1: zeros are ranked by library below all positive ones."""
    by = ["state", "gene"]
    w = Window.partitionBy(*by)
    a = entries.where("stage = 0")
    at = F.row_number().over(w.orderBy("v", "library", "cell"))
    n = F.count("*").over(w)
    return at_quantile(a.withColumn("u", (at - 0.5) / n), entries.where("stage = 1"), by, "u", "moved")


def hurdle_margins(entries: DataFrame, lam: float) -> DataFrame:
    """Stage 0 with a new count of positives and values from blended quantiles, given out in the old order.

    The count is the blend of both stages' shares; the largest, then those of larger libraries, stay positive.
    """
    by = ["state", "gene"]
    w = Window.partitionBy(*by)
    share = lambda s: F.avg(F.when(F.col("stage") == s, (F.col("v") > 0).cast("double")))
    p = entries.groupBy(*by).agg(((1 - lam) * share(0) + lam * share(1)).alias("p"))
    rows = entries.where("stage = 0").join(p, by)
    rows = rows.withColumns({"_k": F.row_number().over(w.orderBy(F.desc("v"), F.desc("library"), "cell")), "_c": F.count("*").over(w)}).withColumn("_m", F.round(F.col("p") * F.col("_c")))
    rows = rows.withColumn("_u", F.when(F.col("_k") <= F.col("_m"), (F.col("_m") - F.col("_k") + 0.5) / F.col("_m")).otherwise(0.0))
    for s, name in ((0, "_l"), (1, "_r")):
        rows = at_quantile(rows, entries.where((F.col("stage") == s) & (F.col("v") > 0)), by, "_u", name)
    value = (1 - lam) * F.col("_l") + lam * F.col("_r")
    return rows.withColumn("decoded", F.when(F.col("_k") <= F.col("_m"), value).otherwise(0.0)).drop("_k", "_c", "_m", "_l", "_r", "_u", "p")


def displaced(df: DataFrame, by: list[str], value: str, delta: str, floor: float, tie: str) -> DataFrame:
    """Values plus their displacement, floored; the sums are then given out in the order of the old values."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_s", F.greatest(F.col(value) + F.col(delta), F.lit(floor))).withColumn("_k", F.row_number().over(w.orderBy(value, tie)))
    repaired = rows.select(*by, F.col("_s").alias("repaired"), F.row_number().over(w.orderBy("_s", tie)).alias("_k"))
    return rows.drop("_s").join(repaired, [*by, "_k"]).drop("_k")


def coupled_mass(coupling: DataFrame, growth: DataFrame, cap: float) -> DataFrame:
    """State masses one step on: mass times bounded growth of its source, summed by target and renormalised."""
    g = growth.select("src", F.least(F.greatest("growth", F.lit(1 / cap)), F.lit(cap)).alias("g"))
    rows = coupling.join(g, "src", "left").groupBy("dst").agg(F.sum(F.col("mass") * F.coalesce("g", F.lit(1.0))).alias("m"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("m").alias("s")))).select("dst", (F.col("m") / F.col("s")).alias("share"))


def softmax_votes(scored: DataFrame, unit: str, score: str, order: str, k: int, temperature: float) -> DataFrame:
    """Weights of the k best of each unit: exp((s - max) / temperature), normalised."""
    w = Window.partitionBy(unit)
    rows = scored.withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), order))).where(F.col("_r") <= k)
    rows = rows.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    return rows.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_r", "_e")


def layers(edges: DataFrame, roots: DataFrame, depth: int, parents: int) -> DataFrame:
    """Strictly forward edges of a breadth-first layering, the best parents of each node.

    edges: src, dst, score; several scores of one edge count by the largest. roots: node.
    """
    best = edges.groupBy("src", "dst").agg(F.max("score").alias("score"))
    seen = roots.select("node", F.lit(0).alias("layer"))
    for d in range(1, depth + 1):
        front = seen.where(F.col("layer") == d - 1).select(F.col("node").alias("src"))
        new = best.join(front, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(d).alias("layer"))
        seen = seen.unionByName(new)
    a, b = (seen.select(F.col("node").alias(n), F.col("layer").alias(f"layer_{n}")) for n in ("src", "dst"))
    forward = best.join(a, "src").join(b, "dst").where("layer_dst > layer_src")
    at = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("score"), "src"))
    return forward.withColumn("_r", at).where(F.col("_r") <= parents).drop("_r")


def axis_warp(points: DataFrame, axis: str, lam: float) -> DataFrame:
    """Stage 0 along one axis at the blend of both stages' quantile functions.

    Both stages are numbered by ranges and met by number, as each is one group, however large.
    """
    sides = [row_numbers(points.where(F.col("stage") == s).withColumn("v", F.col(axis).cast("double")), ["v", "cell"], "_row") for s in (0, 1)]
    sizes = [F.broadcast(side.agg(F.count("*").alias(f"_n{s}"))) for s, side in enumerate(sides)]  # one row each
    rows = sides[0].crossJoin(sizes[0]).crossJoin(sizes[1]).withColumn("_u", (F.col("_row") + 0.5) / F.col("_n0"))
    for s, side in enumerate(sides):
        last = F.col(f"_n{s}") - 1
        at = F.least(F.greatest(F.col("_u") * F.col(f"_n{s}") - 0.5, F.lit(0.0)), last.cast("double"))
        low = F.floor(at + 1e-9)
        rows = rows.withColumns({"_low": low, "_high": F.least(low + 1, last), "_rest": at - low})
        for end in ("_low", "_high"):
            rows = rows.join(side.select(F.col("_row").alias(end), F.col("v").alias(f"{end}{s}")), end, "left")
        rows = rows.withColumn(f"_q{s}", F.col(f"_low{s}") + F.col("_rest") * (F.col(f"_high{s}") - F.col(f"_low{s}"))).drop("_low", "_high", "_rest")
    return rows.withColumn("warped", (1 - lam) * F.col("_q0") + lam * F.col("_q1")).select(*points.columns, "warped")


def held_trend(df: DataFrame, by: list[str], x: str, y: str, at: float, low: float, high: float) -> DataFrame:
    """Log-linear trend at a point; held at the mean where its ratio to the mean leaves the bounds."""
    g = df.groupBy(*by).agg(F.regr_slope(F.log(y), x).alias("a"), F.regr_intercept(F.log(y), x).alias("b"), F.exp(F.avg(F.log(y))).alias("ref"))
    value = F.exp(F.col("a") * at + F.col("b"))
    held = ~(value / F.col("ref")).between(low, high)
    return g.select(*by, F.when(held, F.col("ref")).otherwise(value).alias("value"), held.alias("held"))


def maximal_overlap(parents: DataFrame, quota: DataFrame, by: str, ident: str, seed: int) -> DataFrame:
    """Quotas filled by existing parents first, each once, then again in random order."""
    from .alloc import hash_order

    w = Window.partitionBy(by)
    rows = parents.withColumns({"_k": F.row_number().over(w.orderBy(ident)), "_n": F.count("*").over(w), "_h": hash_order(seed, ident)}).join(quota, by)
    again = F.row_number().over(w.orderBy("_h", ident))
    more = F.greatest(F.col("quota") - F.col("_n"), F.lit(0))
    copies = (F.col("_k") <= F.col("quota")).cast("long") + F.floor(more / F.col("_n")) + F.when(again <= more % F.col("_n"), 1).otherwise(0)
    return rows.withColumn("copies", copies).drop("_k", "_n", "_h", "quota")
