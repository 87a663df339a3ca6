"""Evidence votes: conflicts, gates, caps and reasons; directed signed graphs; ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import settled


def conflicts(votes: DataFrame, keys: list[str]) -> DataFrame:
    """A group with both signs is in conflict: its signed rows become 0, the raw sign stays beside."""
    signs = votes.where("sign <> 0").groupBy(*keys).agg(F.count_distinct("sign").alias("_n"))
    rows = votes.join(signs, keys, "left").withColumn("conflict", F.coalesce(F.col("_n") > 1, F.lit(False)))
    return rows.withColumns({"raw_sign": F.col("sign"), "sign": F.when(F.col("conflict"), 0).otherwise(F.col("sign"))}).drop("_n")


def committee(votes: DataFrame, keys: list[str], least_families: int, cap: int, target: str) -> DataFrame:
    """Votes combined by key: families, conflict, mean rank and confidence, a reason for each group, and a cap per target.

    Reasons, the first that holds: SIGN_CONFLICT, NO_SIGN, TOO_FEW_FAMILIES, GATE_CLOSED, else PASS; passes beyond the cap of
    their target, by falling rank and confidence (null last), become CAP_EXCLUDED.
    """
    signed = F.when(F.col("sign") != 0, F.col("sign"))
    rows = votes.groupBy(*keys).agg(
        F.count_distinct("family").alias("families"), (F.count_distinct(signed) > 1).alias("conflict"), F.max(signed).alias("sign"),
        F.avg("rank_score").alias("rank"), F.avg("confidence").alias("confidence"), F.max("directness").alias("directness"),
        F.bool_or("gate").alias("gate"), F.array_join(F.array_sort(F.collect_set("family")), ";").alias("provenance"),
    )
    reason = F.when(F.col("conflict"), "SIGN_CONFLICT").when(F.col("sign").isNull(), "NO_SIGN").when(F.col("families") < least_families, "TOO_FEW_FAMILIES").when(~F.col("gate"), "GATE_CLOSED").otherwise("PASS")
    rows = rows.withColumn("reason", reason)
    order = [F.when(F.col("reason") == "PASS", 0).otherwise(1), F.desc(F.round("rank", 9)), F.desc(F.round(F.coalesce("confidence", F.lit(-1.0)), 9)), *(k for k in keys if k != target)]
    at = F.row_number().over(Window.partitionBy(target).orderBy(*order))
    return rows.withColumn("reason", F.when((F.col("reason") == "PASS") & (at > cap), "CAP_EXCLUDED").otherwise(F.col("reason")))


def claims(votes: DataFrame, target: str) -> DataFrame:
    """Per target: signed families, conflicts, a status."""
    rows = votes.groupBy(target).agg(F.count_distinct(F.when(F.col("sign") != 0, F.col("family"))).alias("families"), F.count_distinct(F.when(F.col("sign") != 0, F.col("sign"))).alias("_s"))
    status = F.when(F.col("families") == 0, "NO_EVIDENCE").when(F.col("_s") > 1, "CONFLICT").when(F.col("families") == 1, "SINGLE").otherwise("SUPPORTED")
    return rows.withColumn("status", status).drop("_s")


def without_family(votes: DataFrame, target: str) -> DataFrame:
    """Claims with each family held out in turn. Per family and target sums are enough: no vote is repeated for a family."""
    per = votes.groupBy(target, "family").agg(F.max((F.col("sign") > 0).cast("int")).alias("_p"), F.max((F.col("sign") < 0).cast("int")).alias("_m"))
    whole = per.groupBy(target).agg(F.sum("_p").alias("_sp"), F.sum("_m").alias("_sm"), F.sum(F.greatest("_p", "_m")).alias("_f"))
    families = votes.select("family").distinct().withColumnRenamed("family", "held_out")
    rows = whole.crossJoin(F.broadcast(families)).join(per.withColumnRenamed("family", "held_out"), [target, "held_out"], "left").fillna(0, ["_p", "_m"])
    n = F.col("_f") - F.greatest("_p", "_m")
    both = (F.col("_sp") - F.col("_p") > 0) & (F.col("_sm") - F.col("_m") > 0)
    status = F.when(n == 0, "NO_EVIDENCE").when(both, "CONFLICT").when(n == 1, "SINGLE").otherwise("SUPPORTED")
    return rows.select(target, "held_out", n.alias("families"), status.alias("status"))


def edge_sign(directed: Column, stimulates: Column, inhibits: Column) -> Column:
    """+1, -1, or null where an edge is undirected, both or neither."""
    return F.when(directed & stimulates & ~inhibits, 1).when(directed & inhibits & ~stimulates, -1)


def signed_paths(edges: DataFrame, sources: DataFrame, max_hops: int, targets: DataFrame | None = None) -> DataFrame:
    """Paths without revisits (names in lower case) from the sources, with the product of signs; to the targets, if named.

    edges: src, dst, sign; sources: src; targets: dst. One equi-join a hop; the number of hops is a small parameter. With targets
    a path goes on only where one of them is within the hops that are left: what leads nowhere is never made.
    """
    step = edges.select(F.lower("src").alias("src"), F.lower("dst").alias("dst"), "sign").where("sign is not null").distinct()
    at = sources.select(F.lower("src").alias("source")).distinct()
    paths = at.select("source", F.col("source").alias("end"), F.array("source").alias("path"), F.lit(1).alias("sign"))
    out = None
    goals = None if targets is None else settled(targets.select(F.lower("dst").alias("dst")).distinct())
    # Of nodes those from which a target is at most so many hops away.
    near = [] if goals is None else [goals]
    while near and len(near) < max_hops:
        back = step.join(near[-1], "dst", "left_semi").select(F.col("src").alias("dst"))
        near.append(settled(near[-1].union(back).distinct()))
    for hop in range(max_hops):
        on = step if goals is None else step.join(near[max_hops - 1 - hop], "dst", "left_semi")
        e = on.select(F.col("src").alias("end"), F.col("dst"), F.col("sign").alias("s"))
        paths = paths.join(e, "end").where(~F.array_contains("path", F.col("dst")))
        paths = paths.select("source", F.col("dst").alias("end"), F.array_append("path", F.col("dst")).alias("path"), (F.col("sign") * F.col("s")).alias("sign"))
        out = paths if out is None else out.unionByName(paths)
    out = out if goals is None else out.join(goals.withColumnRenamed("dst", "end"), "end", "left_semi")
    return out.select("source", F.col("end").alias("target"), (F.size("path") - 1).alias("hops"), F.array_join("path", ">").alias("path"), "sign")


def closure(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Transitive closure of child, parent; doubles the reach each round until nothing is new."""
    reach = edges.select("child", "parent").distinct()
    n = reach.count()
    for _ in range(rounds):
        more = reach.join(reach.select(F.col("child").alias("parent"), F.col("parent").alias("_p")), "parent").select("child", F.col("_p").alias("parent"))
        reach = reach.unionByName(more).distinct()
        now = reach.count()
        if now == n:
            break
        n = now
    return reach


def board_maximum(ledger: DataFrame, statuses: list[str]) -> DataFrame:
    """Per board the best finite score among rows of some statuses; the first row keeps an exact tie."""
    score = F.col("server_score").try_cast("double")
    rows = ledger.where(F.col("status").isin(statuses)).withColumn("score", score).where("score is not null and not isnan(score) and abs(score) < double('infinity')")
    at = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("score"), "idx"))
    return rows.withColumn("_r", at).where("_r = 1").drop("_r")


def ladder(value: Column, base: Column, band: float = 0.05) -> Column:
    change = (value - base) / F.abs(base)
    return F.when(change > band, "IMPROVE").when(change < -band, "DEGRADE").otherwise("TIER")


def tie_band(df: DataFrame, by: list[str], order: list[str], score: str, band: float) -> DataFrame:
    """Within the band of the score before it, the incumbent is kept."""
    before = F.lag(score).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("decision", F.when(before.isNull(), "FIRST").when(F.abs(F.col(score) - before) <= band, "KEEP").when(F.col(score) > before, "PROMOTE").otherwise("REJECT"))
