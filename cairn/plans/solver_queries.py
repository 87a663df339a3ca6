"""Queries of solvers over small groups, and of what is left of the models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import evidence, fits, geometry, models, ranks, solvers
from cairn.operators import moments as mo
from cairn.operators.lineage import settled

from .join_queries import _LEDGER, _ledger
from .registry import EXPR, POINTS, Tables, query, r


def _placed(t: Tables) -> DataFrame:
    """cell, state, stage, x, y, z and v: eight values of each cell. A solver sees all cells of a state, in one task."""
    return t.points().join(t.cells().select("cell", F.slice("x", 4, 8).alias("v")), "cell")


@query(f"WITH {POINTS}, g AS (SELECT state, count(*) FILTER (stage = 0) AS n0, count(*) FILTER (stage = 1) AS n1, avg(x) FILTER (stage = 0) AS x0, avg(y) FILTER (stage = 0) AS y0, avg(z) FILTER (stage = 0) AS z0, avg(x) FILTER (stage = 1) AS x1, avg(y) FILTER (stage = 1) AS y1, avg(z) FILTER (stage = 1) AS z1 FROM points GROUP BY 1 HAVING count(*) FILTER (stage = 0) > 0 AND count(*) FILTER (stage = 1) > 0), p AS (SELECT a.state AS i, b.state AS j, a.n0 * exp(-abs(a.state - b.state)) AS w FROM g a, g b), plan AS (SELECT i, j, w / (SELECT sum(w) FROM p) AS mass FROM p), cost AS (SELECT a.state AS i, b.state AS j, pow(a.x0 - b.x1, 2) + pow(a.y0 - b.y1, 2) + pow(a.z0 - b.z1, 2) AS c FROM g a, g b), c1 AS (SELECT a.state AS i, b.state AS k, pow(a.x0 - b.x0, 2) + pow(a.y0 - b.y0, 2) + pow(a.z0 - b.z0, 2) AS c FROM g a, g b), c2 AS (SELECT a.state AS j, b.state AS l, pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2) + pow(a.z1 - b.z1, 2) AS c FROM g a, g b), s AS (SELECT sum(pow(c1.c - c2.c, 2) * x.mass * y.mass) AS s FROM plan x, plan y, c1, c2 WHERE c1.i = x.i AND c1.k = y.i AND c2.j = x.j AND c2.l = y.j), m AS (SELECT sum(mass * c) AS m FROM plan JOIN cost USING (i, j)) SELECT round(m, 8) + 0.0 AS linear, round(s, 8) + 0.0 AS structure, round(0.6 * m + 0.4 * s, 8) + 0.0 AS total FROM s, m")
def o7_fused_loss(t: Tables) -> DataFrame:
    """What a plan between states costs by their centroids, and by the distances among the centroids of each stage."""
    g = t.points().groupBy("state").agg(*(F.avg(F.when(F.col("stage") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in "xyz"), *(F.count_if(F.col("stage") == s).alias(f"n{s}") for s in (0, 1)))
    g = settled(g.where("n0 > 0 and n1 > 0"))

    def pairs(one: int, other: int, a: str, b: str) -> DataFrame:
        left = g.select(F.col("state").alias(a), F.col("n0").alias("n"), *(F.col(f"{c}{one}").alias(c) for c in "xyz"))
        right = g.select(F.col("state").alias(b), *(F.col(f"{c}{other}").alias(f"{c}_") for c in "xyz"))
        return left.crossJoin(right).select(a, b, "n", sum((F.pow(F.col(c) - F.col(f"{c}_"), 2) for c in "xyz"), F.lit(0.0)).alias("c"))  # states by states

    cost = pairs(0, 1, "i", "j")
    w = cost.select("i", "j", (F.col("n") * F.exp(-F.abs(F.col("i") - F.col("j")))).alias("w"))
    plan = settled(w.crossJoin(w.agg(F.sum("w").alias("all"))).select("i", "j", (F.col("w") / F.col("all")).alias("mass")))
    loss = solvers.fused_loss(plan, cost.drop("n"), pairs(0, 0, "i", "k").drop("n"), pairs(1, 1, "j", "l").drop("n"), 0.4)
    return loss.select(*(r(c, 8).alias(c) for c in ("linear", "structure", "total")))


@query()
def o7_fused_coupling(t: Tables) -> DataFrame:
    """States of both stages coupled by the distance of centroids and by the distances among them."""
    from .metric_queries import _state_cost

    states, cost, a, b = _state_cost(t)
    g = t.points().groupBy("state").agg(*(F.avg(F.when(F.col("stage") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in "xyz")).where(F.col("state").isin(states)).orderBy("state").collect()
    c1, c2 = (((p[:, None] - p[None]) ** 2).sum(2) for p in (np.array([[x[f"{c}{s}"] for c in "xyz"] for x in g]) for s in (0, 1)))
    plan = solvers.fused_coupling(cost / np.median(cost), c1 / np.median(c1[c1 > 0]), c2 / np.median(c2[c2 > 0]), a, b, 0.5, 0.1)
    return t.spark.createDataFrame([(s, d, float(round(plan[i, j], 8))) for i, s in enumerate(states) for j, d in enumerate(states)], "src int, dst int, mass double")


@query()
def o9_swapped_pairing(t: Tables) -> DataFrame:
    def pair(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g.stage == 0].sort_values("cell")
        p, z = g[["x", "y", "z"]].to_numpy(), np.stack(g.v.to_list())
        graph = geometry.first_gaps(p, p, 4)
        at = solvers.swapped_pairing(z, z[graph].mean(1)[::-1].copy(), graph)
        return pd.DataFrame({"cell": g.cell.to_numpy(), "row_of": g.cell.to_numpy()[at]})

    return _placed(t).groupBy("state").applyInPandas(pair, "cell long, row_of long")


@query()
def g8_rigid_registration(t: Tables) -> DataFrame:
    def register(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g[g.stage == s].sort_values("cell") for s in (0, 1))
        x, y = (v[["x", "y", "z"]].to_numpy() for v in (a, b))
        turn, shift = solvers.rigid_em(x, y)
        out = (x @ turn + shift).round(6)
        return pd.DataFrame({"cell": a.cell.to_numpy(), "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    return _placed(t).groupBy("state").applyInPandas(register, "cell long, x double, y double, z double")


@query()
def y25_rewired_rows(t: Tables) -> DataFrame:
    def rewire(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g[g.stage == s].sort_values("cell") for s in (0, 1))
        p, q = (v[["x", "y", "z"]].to_numpy() for v in (a, b))
        s, u = (np.stack(v.v.to_list())[:, :3] for v in (a, b))
        at = solvers.rewired(p, s, (p, s), (q, u), 0.5)
        return pd.DataFrame({"cell": a.cell.to_numpy(), "row_of": a.cell.to_numpy()[at]})

    return _placed(t).groupBy("state").applyInPandas(rewire, "cell long, row_of long")


@query(f"WITH {EXPR}, w AS (SELECT cell, max(v) FILTER (gene = 1) AS a, max(v) FILTER (gene = 2) AS b, max(v) FILTER (gene = 3) AS c FROM expr GROUP BY 1) SELECT cell, 0.0 AS a, round(b - 0.5 * a, 8) + 0.0 AS b, round(c - 0.2 * a + 0.3 * 0.5 * a, 8) + 0.0 AS c FROM w")
def x21_counterfactual(t: Tables) -> DataFrame:
    wide = t.cells().select("cell", *(F.get("x", F.lit(i)).alias(n) for i, n in enumerate("abc")))
    out = solvers.counterfactual(wide, "a", 0.0, {"b": {"a": 0.5}, "c": {"a": 0.2, "b": -0.3}})
    return out.select("cell", *(r(c, 8).alias(c) for c in "abc"))


@query()
def l2_low_rank_predictor(t: Tables) -> DataFrame:
    """The second half of each cell of stage 1 foretold from its first half, by four response factors of the cells of stage 0."""
    c = t.cells().select(F.col("cell").alias("id"), "stage", F.slice("x", 1, 32).alias("x"), F.slice("x", 33, 32).alias("y"))
    out = fits.kernel_predictor(c.where("stage = 0"), c.where("stage = 1"), 1.0, rank=4)
    return out.select(F.col("id").alias("cell"), F.transform("prediction", lambda v: r(v, 6)).alias("prediction"))


@query()
def l4_term_embedding(t: Tables) -> DataFrame:
    """Parts' brands embedded by the sizes they come in, on four singular vectors of how often they do."""
    m = t("part").groupBy(F.col("p_brand").alias("row"), F.col("p_size").alias("term")).agg(F.count("*").alias("v"))
    return fits.term_embedding(m, 4, 1e-7, 400).select(F.col("row").alias("brand"), F.transform("embedding", lambda v: r(v, 4)).alias("embedding"))


@query(f"WITH {EXPR}, j AS (SELECT a.state AS state, a.stage AS stage, b.gene AS gene, a.v AS x, b.v AS y FROM expr a JOIN expr b USING (cell) WHERE a.gene = 4 AND b.gene <> 4), m AS (SELECT state, stage, gene, avg(x) AS mx, avg(y) AS my FROM j GROUP BY ALL), s AS (SELECT state, gene, round(sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)), 9) AS w FROM j JOIN m USING (state, stage, gene) GROUP BY ALL) SELECT state, gene, CAST(-sign(w) AS INTEGER) AS effect_sign, round(row_number() OVER (PARTITION BY state ORDER BY abs(w), gene) / (count(*) OVER (PARTITION BY state) + 1), 8) + 0.0 AS confidence FROM s")
def l9_knockout_votes(t: Tables) -> DataFrame:
    """The loss of a gene's value as a vote on the others: the slope on it within each stage, sign turned."""
    e = t.expr()
    j = e.where("gene <> 4").join(e.where("gene = 4").select("cell", F.col("v").alias("x")), "cell").withColumnRenamed("v", "y")
    s = models.demeaned_slope(j, "stage", "x", "y", 1, ["state", "gene"]).withColumn("slope", F.round("slope", 9))
    w = Window.partitionBy("state")
    k = F.row_number().over(w.orderBy(F.abs("slope"), "gene")) / (F.count("*").over(w) + 1)
    return s.select("state", "gene", (-F.signum("slope")).cast("int").alias("effect_sign"), r(k, 8).alias("confidence"))


@query(f"WITH {EXPR}, s AS (SELECT cell, state, stage, round(sum(v * CASE WHEN gene % 4 = 0 THEN 2.0 ELSE 1.0 END) FILTER (gene <= 20), 9) AS s FROM expr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY state, stage ORDER BY s, cell) AS k, count(*) OVER (PARTITION BY state, stage) AS n FROM s) SELECT a.cell, b.cell AS donor FROM k a JOIN k b ON a.state = b.state AND a.stage = 0 AND b.stage = 1 AND b.k = CAST(floor((a.k - 0.5) / a.n * b.n) AS BIGINT) + 1")
def l14_joint_donors(t: Tables) -> DataFrame:
    """Whole profiles of stage 1 given to cells of stage 0 by the rank of a weighted score."""
    score = F.round(F.sum(F.when(F.col("gene") <= 20, F.col("v") * F.when(F.col("gene") % 4 == 0, 2.0).otherwise(1.0))), 9)
    w = Window.partitionBy("state", "stage")
    s = t.expr().groupBy("cell", "state", "stage").agg(score.alias("s"))
    s = s.withColumns({"k": F.row_number().over(w.orderBy("s", "cell")).cast("long"), "n": F.count("*").over(w)})
    donors = s.where("stage = 1").select("state", F.col("k").alias("at"), F.col("cell").alias("donor"))
    size = donors.groupBy("state").agg(F.count("*").alias("m"))
    a = s.where("stage = 0").join(size, "state").withColumn("at", F.floor((F.col("k") - 0.5) / F.col("n") * F.col("m")) + 1)
    return a.join(donors, ["state", "at"]).select("cell", "donor")


def blended(t: Tables) -> DataFrame:
    """Entries dealt out by a blend of their own rank and that of a neighbour-gene prediction."""
    e = t.expr().withColumn("z", ranks.normal_quantile(ranks.normalised_rank("v", ["state", "gene"])))
    b = t.spark.range(1, 65).select(F.col("id").alias("gene")).crossJoin(F.broadcast(t.spark.range(1, 65).select(F.col("id").alias("to"))))
    b = b.where("gene <> to").withColumn("w", F.lit(0.4) / F.abs(F.col("gene") - F.col("to")))
    c = e.join(F.broadcast(b), "gene").groupBy("cell", F.col("to").alias("gene")).agg(F.round(F.sum(F.col("z") * F.col("w")), 9).alias("conditional"))
    return ranks.copula_restored(e.join(c, ["cell", "gene"]), ["state", "gene"], "v", "conditional", 0.5, "cell")


@query()
def y23_rank_gaussian_blend(t: Tables) -> DataFrame:
    return blended(t).select("cell", "gene", r("restored").alias("restored"))


@query()
def y27_spline_hurdle(t: Tables) -> DataFrame:
    """Presence and positive mean of each gene on hinges of gene 1: sums by gene, one small system each."""
    e = t.expr()
    a = e.where("gene = 1").select("cell", F.col("v").alias("a"))
    rows = e.where("gene > 1").join(a, "cell")
    basis = [F.lit(1.0), F.col("a"), *(F.greatest(F.col("a") - k, F.lit(0.0)) for k in (0.05, 0.1, 0.2))]
    n, on = len(basis), (F.col("v") > 0).cast("double")
    sums = [F.sum(x * y).alias(f"g{i}_{j}") for i, x in enumerate(basis) for j, y in enumerate(basis)]
    pos = [F.sum(x * y * on).alias(f"h{i}_{j}") for i, x in enumerate(basis) for j, y in enumerate(basis)]
    g = rows.groupBy("gene").agg(*sums, *pos, *(F.sum(x * on).alias(f"p{i}") for i, x in enumerate(basis)), *(F.sum(x * F.col("v") * on).alias(f"m{i}") for i, x in enumerate(basis)))

    def solve(batches):
        for b in batches:
            out = {"gene": b.gene}
            for kind, left, right in (("presence", "g", "p"), ("mean", "h", "m")):
                a = np.array([[b[f"{left}{i}_{j}"] for j in range(n)] for i in range(n)], float).transpose(2, 0, 1) + np.eye(n)
                y = np.array([b[f"{right}{i}"] for i in range(n)], float).T
                out[kind] = list(np.linalg.solve(a, y[..., None])[..., 0].round(8))
            yield pd.DataFrame(out)

    return g.mapInPandas(solve, "gene long, presence array<double>, mean array<double>")


@query(f"WITH {_LEDGER}, s AS (SELECT *, TRY_CAST(server_score AS DOUBLE) AS score FROM ledger WHERE status IN ('scored', 'final')), k AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY score DESC, idx) AS k FROM s WHERE isfinite(score)) SELECT 1 AS part, '- ' || board || ': **' || CAST(CAST(score AS BIGINT) AS VARCHAR) || '** (v' || version || ')' AS line FROM k WHERE k = 1 UNION ALL SELECT 2, '- ' || status || ': ' || count(*) FROM ledger GROUP BY status")
def k7_audit_report(t: Tables) -> DataFrame:
    """Lines of the audit: the best of each board, then counts by status."""
    ledger = _ledger(t)
    best = evidence.board_maximum(ledger, ["scored", "final"])
    lines = best.select(F.lit(1).alias("part"), F.concat(F.lit("- "), "board", F.lit(": **"), F.col("score").cast("long").cast("string"), F.lit("** (v"), F.col("version").cast("string"), F.lit(")")).alias("line"))
    counts = mo.shares(ledger, ["status"]).select(F.lit(2).alias("part"), F.concat(F.lit("- "), "status", F.lit(": "), F.col("n").cast("string")).alias("line"))
    return lines.unionByName(counts)
