"""Queries of metrics, geometry and transport (2.11)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import couplings, geometry, joins, metrics
from cairn.operators import moments as mo
from cairn.operators.lineage import settled

from .registry import CELLS, EXPR, POINTS, Tables, query, r

_MW = f"""WITH {EXPR}, k AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene, v) AS t FROM expr),
g AS (SELECT gene, sum(CASE WHEN stage = 1 THEN r ELSE 0 END) AS s, count(*) FILTER (stage = 1) AS n1, count(*) FILTER (stage = 0) AS n0, sum(t * t - 1.0) AS ties FROM k GROUP BY 1),
u AS (SELECT gene, s - n1 * (n1 + 1) / 2 AS u, (s - n1 * (n1 + 1) / 2 - n1 * n0 / 2.0) / sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM g),
x AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS h FROM u),
p AS (SELECT gene, u, z, least(((((1.061405429 * h - 1.453152027) * h + 1.421413741) * h - 0.284496736) * h + 0.254829592) * h * exp(-z * z / 2), 1) AS p FROM x)"""


@query(_MW + " SELECT gene, round(u, 4) + 0.0 AS u, round(z, 6) + 0.0 AS z, round(p, 6) + 0.0 AS p FROM p")
def q1_mann_whitney(t: Tables) -> DataFrame:
    return metrics.mann_whitney(t.expr(), ["gene"]).select("gene", r("u", 4).alias("u"), r("z").alias("z"), r("p").alias("p"))


@query(_MW + ", o AS (SELECT gene, p, row_number() OVER (ORDER BY p, gene) AS k, count(*) OVER () AS m FROM p) SELECT gene, k <= coalesce(max(CASE WHEN round(p, 12) <= round(0.6 * k / m, 12) THEN k END) OVER (), 0) AS significant FROM o")
def q2_step_up(t: Tables) -> DataFrame:
    p = metrics.mann_whitney(t.expr(), ["gene"]).withColumn("one", F.lit(1))
    return metrics.step_up(p, ["one"], "p", 0.6, "gene").select("gene", "significant")


_EFFECTS = f"WITH {EXPR}, e AS (SELECT state, gene, avg(v) FILTER (cell % 3 = 1) - avg(v) FILTER (cell % 3 = 0) AS truth, avg(v) FILTER (cell % 3 = 2) - avg(v) FILTER (cell % 3 = 0) AS pred, avg(v) AS ref FROM expr GROUP BY ALL)"


def _effects(t: Tables) -> DataFrame:
    on = lambda k: F.avg(F.when(F.col("cell") % 3 == k, F.col("v")))
    return t.expr().groupBy("state", "gene").agg((on(1) - on(0)).alias("truth"), (on(2) - on(0)).alias("pred"), F.avg("v").alias("ref"))


@query(_EFFECTS + ", k AS (SELECT state, row_number() OVER (PARTITION BY state ORDER BY round(abs(truth), 9) DESC, gene) <= 16 AS a, row_number() OVER (PARTITION BY state ORDER BY round(abs(pred), 9) DESC, gene) <= 16 AS b, row_number() OVER (PARTITION BY state ORDER BY round(ref, 9) DESC, gene) <= 16 AS c FROM e), o AS (SELECT state, count(*) FILTER (a AND b) / 16.0 AS o, greatest(count(*) FILTER (a AND c) / 16.0, 0.25) AS ch FROM k GROUP BY 1) SELECT state, round((o - ch) / (1 - ch), 6) + 0.0 AS score FROM o WHERE ch < 1")
def q3_effect_overlap(t: Tables) -> DataFrame:
    from cairn.operators.ranks import top_k

    e = _effects(t)
    for name, order in (("a", F.desc(F.round(F.abs("truth"), 9))), ("b", F.desc(F.round(F.abs("pred"), 9))), ("c", F.desc(F.round("ref", 9)))):
        e = top_k(e, ["state"], [order, "gene"], 16).withColumn(name, F.col("kept")).drop("kept", "position")
    o = e.groupBy("state").agg((F.count_if(F.col("a") & F.col("b")) / 16).alias("o"), F.greatest(F.count_if(F.col("a") & F.col("c")) / 16, F.lit(0.25)).alias("ch"))
    return o.where("ch < 1").select("state", r(metrics.overlap_score(F.col("o"), F.col("ch"))).alias("score"))


@query(_EFFECTS + ", k AS (SELECT state, rank() OVER (PARTITION BY state ORDER BY truth) + (count(*) OVER (PARTITION BY state, truth) - 1) / 2.0 AS x, rank() OVER (PARTITION BY state ORDER BY pred) + (count(*) OVER (PARTITION BY state, pred) - 1) / 2.0 AS y, rank() OVER (PARTITION BY state ORDER BY ref) + (count(*) OVER (PARTITION BY state, ref) - 1) / 2.0 AS g FROM e), c AS (SELECT state, corr(x, y) AS xy, corr(x, g) AS xg, corr(y, g) AS yg FROM k GROUP BY 1) SELECT state, round((xy - xg * yg) / sqrt((1 - xg * xg) * (1 - yg * yg)), 5) + 0.0 AS rho FROM c")
def q4_effect_direction(t: Tables) -> DataFrame:
    return metrics.partial_rank_correlation(_effects(t), ["state"], "truth", "pred", "ref").select("state", r("rho", 5).alias("rho"))


@query(_EFFECTS + ", l AS (SELECT state, ln(greatest(abs(truth), 1e-3)) - ln(1e-3) AS x, ln(greatest(abs(pred), 1e-3)) - ln(1e-3) AS y FROM e), s AS (SELECT state, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM l GROUP BY 1) SELECT state, round(CASE WHEN xy * xy / (xx * yy) >= 0.01 THEN xy / xx END, 6) + 0.0 AS slope, round(xy * xy / (xx * yy), 6) + 0.0 AS r2 FROM s")
def q5_severity_slope(t: Tables) -> DataFrame:
    return metrics.severity_slope(_effects(t), ["state"], "pred", "truth").select("state", r("slope").alias("slope"), r("r2").alias("r2"))


@query(f"WITH {CELLS}, k AS (SELECT cell, state, stage, list_transform(e, lambda v: greatest(CAST(v AS DOUBLE), 0)) AS x, row_number() OVER (PARTITION BY state, stage ORDER BY md5(CAST(cell AS VARCHAR)), cell) AS k FROM cells), s AS (SELECT * FROM k WHERE k <= 1500), d AS (SELECT a.state, a.stage AS s1, b.stage AS s2, list_distance(a.x, b.x) AS d FROM s a JOIN s b ON a.state = b.state AND a.cell <> b.cell) SELECT state, round(2 * avg(d) FILTER (s1 <> s2) - avg(d) FILTER (s1 = 0 AND s2 = 0) - avg(d) FILTER (s1 = 1 AND s2 = 1), 6) + 0.0 AS energy FROM d GROUP BY 1")
def q7_energy_distance(t: Tables) -> DataFrame:
    return metrics.energy_distance(t.cells(), "state", 1500).select("state", r("energy").alias("energy"))


@query(f"WITH {EXPR}, p AS (SELECT a.stage, a.gene * 1000 + b.gene AS pair, avg(sqrt(abs(a.v - b.v))) AS w FROM expr a JOIN expr b ON a.cell = b.cell AND a.gene < b.gene GROUP BY ALL), g AS (SELECT pair, max(w) FILTER (stage = 1) - max(w) FILTER (stage = 0) AS d FROM p GROUP BY 1) SELECT round(avg(d * d), 8) + 0.0 AS score, round(sqrt(avg(d * d)), 6) + 0.0 AS root FROM g")
def q8_q9_variogram(t: Tables) -> DataFrame:
    return metrics.variogram_gap(t.expr(), list(range(1, 65))).select(r("score", 8).alias("score"), r("root").alias("root"))


@query(f"WITH {EXPR}, m AS (SELECT gene, avg(v) FILTER (stage = 0) AS b, avg(v) FILTER (stage = 1) AS a, var_pop(v) FILTER (stage = 0) AS vb, var_pop(v) FILTER (stage = 1) AS va FROM expr GROUP BY 1), l AS (SELECT cell, stage, sum(exp(least(v, 50)) - 1) AS l FROM expr GROUP BY ALL) SELECT round(sqrt(sum((a - b) * (a - b)) / sum(b * b)), 8) + 0.0 AS rel_err, round(avg(va / vb), 6) + 0.0 AS variance_ratio, round((SELECT quantile_cont(l, 0.5) FILTER (stage = 1) / quantile_cont(l, 0.5) FILTER (stage = 0) FROM l), 6) + 0.0 AS library_ratio FROM m")
def q10_q11_q12_bulk_ratios(t: Tables) -> DataFrame:
    entries = t.expr()
    on = lambda s, f: f(F.when(F.col("stage") == s, F.col("v")))
    m = entries.groupBy("gene").agg(on(0, F.avg).alias("b"), on(1, F.avg).alias("a"), on(0, F.var_pop).alias("vb"), on(1, F.var_pop).alias("va"))
    whole = m.agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2)) / F.sum(F.col("b") * F.col("b"))).alias("e"), F.avg(F.col("va") / F.col("vb")).alias("v"))
    lib = entries.groupBy("cell", "stage").agg(F.sum(F.expm1(F.least("v", F.lit(50.0)))).alias("l"))
    half = lambda s: F.percentile(F.when(F.col("stage") == s, F.col("l")), F.lit(0.5))
    ratio = lib.agg((half(1) / half(0)).alias("l"))
    return whole.crossJoin(F.broadcast(ratio)).select(r("e", 8).alias("rel_err"), r("v").alias("variance_ratio"), r("l").alias("library_ratio"))


@query("WITH m AS (SELECT user_id % 8 AS unit, event_type AS metric, avg(abs(value - 50)) AS d, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT unit, metric, CASE WHEN unit = 3 AND metric = 'click' THEN NULL ELSE least(20 / (20 + d), 1) END AS skill FROM m), w AS (SELECT *, CASE metric WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 1.0 END AS w FROM s) SELECT unit, round(sum(w * coalesce(100 * skill, 50)) / sum(w), 6) + 0.0 AS total FROM w GROUP BY 1")
def q13_q14_skill_composite(t: Tables) -> DataFrame:
    m = t("events").groupBy((F.col("user_id") % 8).alias("unit"), F.col("event_type").alias("metric")).agg(F.avg(F.abs(F.col("value") - 50)).alias("d"))
    s = m.withColumn("skill", F.when((F.col("unit") == 3) & (F.col("metric") == "click"), None).otherwise(metrics.skill(F.col("d"), F.lit(20.0))))
    kinds = {x: 1.0 for x in ("purchase", "signup", "error", "login", "logout", "scroll", "search", "add_to_cart", "share")} | {"click": 2.0, "view": 0.5}
    return metrics.composite(s, kinds, "unit").select("unit", r("total").alias("total"))


_NN = f"WITH {EXPR}, {POINTS}, d AS (SELECT a.cell AS src, b.cell AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM points a JOIN points b USING (state)), n AS (SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY (src <> dst)::INT, round(dist, 9), dst) AS k FROM d) WHERE k <= 5)"


def _near(t: Tables, keep_self: bool = True) -> DataFrame:
    return joins.neighbours(t.points(), 5, ["state"], keep_self=keep_self)


@query(_NN + ", h AS (SELECT src, gene, avg(v) AS m FROM n JOIN expr ON dst = cell GROUP BY ALL), j AS (SELECT src, gene, m, v FROM h JOIN expr ON src = cell AND h.gene = expr.gene) SELECT src, round(corr(m, v), 5) + 0.0 AS pearson FROM (SELECT src, j.gene, m, v FROM j) GROUP BY 1 HAVING corr(m, v) IS NOT NULL".replace("SELECT src, gene, m, v FROM h", "SELECT src, h.gene, m, v FROM h"))
def q15_neighbourhood_pearson(t: Tables) -> DataFrame:
    e = t.expr()
    h = _near(t).join(e.select(F.col("cell").alias("dst"), "gene", "v"), "dst").groupBy("src", "gene").agg(F.avg("v").alias("m"))
    j = h.join(e.select(F.col("cell").alias("src"), "gene", "v"), ["src", "gene"])
    return j.groupBy("src").agg(F.corr("m", "v").alias("c")).where("c is not null and not isnan(c)").select("src", r("c", 5).alias("pearson"))


@query("WITH a AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) / (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS p, count(*) FILTER (event_id % 2 = 1) / (SELECT count(*) FROM events WHERE event_id % 2 = 1) AS q FROM events GROUP BY 1) SELECT round(sum(abs(p - q)), 8) + 0.0 AS l1 FROM a")
def q16_composition_distance(t: Tables) -> DataFrame:
    side = t("events").withColumn("k", F.col("event_id") % 2)
    s = mo.shares(side, ["event_type"], ["k"])
    both = s.groupBy("event_type").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("share"))), F.lit(0.0)).alias(f"p{k}") for k in (0, 1)))
    return both.agg(r(F.sum(F.abs(F.col("p0") - F.col("p1"))), 8).alias("l1"))


@query(f"WITH {POINTS}, d AS (SELECT a.cell AS src, b.cell AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d3, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d2 FROM points a JOIN points b ON a.state = b.state AND a.cell <> b.cell), p AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d3, 9), dst) AS k FROM d) WHERE k <= 5), q AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d2, 9), dst) AS k FROM d) WHERE k <= 5), o AS (SELECT p.src, count(q.dst) / count(*) AS o FROM p LEFT JOIN q ON p.src = q.src AND p.dst = q.dst GROUP BY 1) SELECT round(avg(o), 6) + 0.0 AS mean, round(quantile_cont(o, 0.5), 6) + 0.0 AS median, round(avg((o < 0.5)::INT), 6) + 0.0 AS below FROM o")
def q17_neighbour_overlap(t: Tables) -> DataFrame:
    flat = t.points().withColumn("z", F.lit(0.0))
    p, q = (joins.neighbours(x, 5, ["state"]).select("src", "dst") for x in (t.points(), flat))
    o = p.join(q.withColumn("hit", F.lit(1)), ["src", "dst"], "left").groupBy("src").agg((F.count("hit") / F.count("*")).alias("o"))
    return o.agg(r(F.avg("o")).alias("mean"), r(F.percentile("o", F.lit(0.5))).alias("median"), r(F.avg((F.col("o") < 0.5).cast("double"))).alias("below"))


@query(_NN + " SELECT state, gene, round(quantile_cont((a.v - b.v) * (a.v - b.v) / 2, 0.5), 8) + 0.0 AS median, round(avg((a.v - b.v) * (a.v - b.v) / 2), 8) + 0.0 AS mean FROM n JOIN expr a ON a.cell = src JOIN expr b ON b.cell = dst AND b.gene = a.gene WHERE src <> dst GROUP BY 1, 2".replace("SELECT state, gene,", "SELECT a.state, a.gene,"))
def q19_semivariance(t: Tables) -> DataFrame:
    e = t.expr()
    n = _near(t).where("src <> dst").join(e.select(F.col("cell").alias("src"), "gene", F.col("v").alias("a")), "src").join(e.select(F.col("cell").alias("dst"), "gene", F.col("v").alias("b")), ["dst", "gene"])
    half = F.pow(F.col("a") - F.col("b"), 2) / 2
    return n.groupBy("state", "gene").agg(r(F.percentile(half, F.lit(0.5)), 8).alias("median"), r(F.avg(half), 8).alias("mean"))


_RUNS = "runs AS (SELECT event_type AS method, user_id % 6 AS query, avg(value) AS s FROM events GROUP BY ALL), p AS (SELECT method, query, s, max(s) FILTER (method = 'click') OVER (PARTITION BY query) AS control, max(s) FILTER (method = 'view') OVER (PARTITION BY query) AS second FROM runs)"


@query(f"WITH {_RUNS} SELECT method, round(avg(s - control), 6) + 0.0 AS gain, count(*) FILTER (s > control) AS wins, avg(s - control) > 0 AND count(*) FILTER (s > control) >= 4 AND min(s - control) >= -2 AS promoted, CASE WHEN bool_and(s > control AND s > second) THEN 'BEATS_BOTH' WHEN bool_or(s > control) THEN 'MIXED' ELSE 'LOSES' END AS verdict, round(avg(((s > control) = (s > second))::INT), 6) + 0.0 AS agreement FROM p GROUP BY 1")
def q22_q23_q24_q27_promotion(t: Tables) -> DataFrame:
    runs = t("events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 6).alias("query")).agg(F.avg("value").alias("s"))
    control = runs.where("method in ('click', 'view')").groupBy("query").pivot("method", ["click", "view"]).agg(F.max("s"))
    p = runs.join(control, "query")
    win, win2, gain = F.col("s") > F.col("click"), F.col("s") > F.col("view"), F.col("s") - F.col("click")
    verdict = F.when(F.bool_and(win & win2), "BEATS_BOTH").when(F.bool_or(win), "MIXED").otherwise("LOSES")
    return p.groupBy("method").agg(r(F.avg(gain)).alias("gain"), F.count_if(win).alias("wins"), ((F.avg(gain) > 0) & (F.count_if(win) >= 4) & (F.min(gain) >= -2)).alias("promoted"), verdict.alias("verdict"), r(F.avg((win == win2).cast("double"))).alias("agreement"))


@query(f"WITH {POINTS}, m AS (SELECT state, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS r FROM points GROUP BY 1) SELECT cell, round((x - mx) * 2 / r, 6) + 0.0 AS x, round((y - my) * 2 / r, 6) + 0.0 AS y, round((z - mz) * 2 / r, 6) + 0.0 AS z FROM points JOIN m USING (state)")
def g1_scale_to_rms(t: Tables) -> DataFrame:
    return geometry.to_rms(t.points(), ["state"], 2.0).select("cell", *(r(c).alias(c) for c in "xyz"))


@query(f"WITH {POINTS}, c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sqrt((var_pop(x) + var_pop(y) + var_pop(z)) / (1.44 * var_pop(x) + var_pop(y) + 0.64 * var_pop(z))) AS k FROM points) SELECT cell, round(mx + (x - mx) * 1.2 * k, 6) + 0.0 AS x, round(my + (y - my) * k, 6) + 0.0 AS y, round(mz + (z - mz) * 0.8 * k, 6) + 0.0 AS z FROM points, c")
def g3_anisotropic_warp(t: Tables) -> DataFrame:
    return geometry.warped(t.points(), (1.2, 1.0, 0.8)).select("cell", *(r(c).alias(c) for c in "xyz"))


@query(f"WITH {POINTS}, a AS (SELECT avg(x) AS ax, avg(y) AS ay, avg(z) AS az, count(*) / 100.0 AS w FROM points GROUP BY state) SELECT cell, round(sum(w * exp(-(pow(x - ax, 2) + pow(y - ay, 2) + pow(z - az, 2)) / (2 * 0.04))), 6) + 0.0 AS field FROM points, a GROUP BY 1")
def g6_gaussian_field(t: Tables) -> DataFrame:
    p = t.points()
    anchors = p.groupBy("state").agg(*(F.avg(c).alias(c) for c in "xyz"), (F.count("*") / 100).alias("w")).drop("state")
    return geometry.gaussian_field(p, anchors, 0.2).select("cell", r("field").alias("field"))


@query()
def g2_canonical_cloud(t: Tables) -> DataFrame:
    return geometry.canonical(t.points()).select("cell", *(r(c).alias(c) for c in "xyz"))


@query()
def g4_procrustes(t: Tables) -> DataFrame:
    p = t.points()
    origin, turn, goal = geometry.procrustes(p.where("stage = 0"), p.where("stage = 1"), "state")
    return geometry.transformed(p.where("stage = 0"), origin, turn, goal).select("cell", *(r(c).alias(c) for c in "xyz"))


@query()
def g5_o10_bures_interpolation(t: Tables) -> DataFrame:
    p = t.points()
    (m0, c0), (m1, c1) = (geometry.covariance(p.where(F.col("stage") == s)) for s in (0, 1))
    half = 0.5 * np.eye(3) + 0.5 * geometry.bures_map(c0, c1)
    return geometry.transformed(p.where("stage = 0"), m0, half.T, 0.5 * (m0 + m1)).select("cell", *(r(c).alias(c) for c in "xyz"))


def _state_cost(t: Tables) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """States, the cost of moving between their centroids, and their shares in both stages."""
    g = t.points().groupBy("state").agg(*(F.avg(F.when(F.col("stage") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in "xyz"), *(F.count_if(F.col("stage") == s).alias(f"n{s}") for s in (0, 1)))
    rows = g.where("n0 > 0 and n1 > 0").orderBy("state").collect()  # a row for each state
    a, b = (np.array([[x[f"{c}{s}"] for c in "xyz"] for x in rows]) for s in (0, 1))
    n0, n1 = (np.array([x[f"n{s}"] for x in rows], float) for s in (0, 1))
    return [x["state"] for x in rows], ((a[:, None] - b[None]) ** 2).sum(2), n0 / n0.sum(), n1 / n1.sum()


_PROGRAMME = f"""WITH {EXPR}, p AS (SELECT state, stage, gene % 8 AS programme, avg(v) AS m FROM expr GROUP BY ALL), z AS (SELECT state, stage, programme, CASE WHEN stddev_pop(m) OVER w > 0 THEN (m - avg(m) OVER w) / stddev_pop(m) OVER w ELSE 0 END AS z FROM p WINDOW w AS (PARTITION BY programme)),
d AS (SELECT a.state AS src, b.state AS dst, sqrt(sum(pow(a.z - b.z, 2))) AS d FROM z a JOIN z b USING (programme) WHERE a.stage = 0 AND b.stage = 1 GROUP BY ALL), k AS (SELECT quantile_cont(d, 0.5) AS half FROM d)"""


@query(_PROGRAMME + " SELECT src, dst, round(d / half + CASE WHEN src // 5 <> dst // 5 THEN 0.5 ELSE 0 END, 6) + 0.0 AS cost FROM d, k")
def o3_coupling_cost(t: Tables) -> DataFrame:
    """What it costs to go from a state to another: how far their standardised programmes are apart, against the median, and
    half as much again between lineages."""
    p = t.expr().groupBy("state", "stage", (F.col("gene") % 8).alias("programme")).agg(F.avg("v").alias("m"))
    w = Window.partitionBy("programme")
    spread = F.stddev_pop("m").over(w)
    z = p.withColumn("z", F.when(spread > 0, (F.col("m") - F.avg("m").over(w)) / spread).otherwise(0.0))
    a, b = (z.where(F.col("stage") == s).select(F.col("state").alias(n), "programme", F.col("z").alias(f"z{s}")) for s, n in ((0, "src"), (1, "dst")))
    d = a.join(b, "programme").groupBy("src", "dst").agg(F.sqrt(F.sum(F.pow(F.col("z0") - F.col("z1"), 2))).alias("d"))
    half = F.broadcast(d.agg(F.percentile("d", F.lit(0.5)).alias("half")))  # one row
    apart = F.when(F.floor(F.col("src") / 5) != F.floor(F.col("dst") / 5), 0.5).otherwise(0.0)
    return d.crossJoin(half).select("src", "dst", r(F.col("d") / F.col("half") + apart).alias("cost"))


def _state_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cost of moving between the centroids of states, against the median, and their shares in both stages, as tables."""
    g = t.points().groupBy("state").agg(*(F.avg(F.when(F.col("stage") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in "xyz"), *(F.count_if(F.col("stage") == s).alias(f"n{s}") for s in (0, 1)))
    g = settled(g.where("n0 > 0 and n1 > 0"))
    right = g.select(F.col("state").alias("j"), *(F.col(f"{c}1") for c in "xyz"))
    c = g.select(F.col("state").alias("i"), *(f"{c}0" for c in "xyz")).crossJoin(right).select("i", "j", sum((F.pow(F.col(f"{c}0") - F.col(f"{c}1"), 2) for c in "xyz"), F.lit(0.0)).alias("c"))
    half = c.agg(F.percentile("c", F.lit(0.5)).alias("half"))  # one row
    share = lambda n, k: g.crossJoin(g.agg(F.sum(n).alias("all"))).select(F.col("state").alias(k), (F.col(n) / F.col("all")).alias("p"))
    return c.crossJoin(half).select("i", "j", (F.col("c") / F.col("half")).alias("c")), share("n0", "i"), share("n1", "j")


def _coupling_sql(rho: float | None) -> str:
    """The same updates on lists of one row, 400 times."""
    factor = 0.1 if rho is None else rho / (rho + 0.1) * 0.1
    soft = lambda x: f"list_transform([{x}], lambda q: list_max(q) + ln(list_sum(list_transform(q, lambda v: exp(v - list_max(q))))))[1]"
    return f"""WITH RECURSIVE {POINTS}, g AS (SELECT state, count(*) FILTER (stage = 0) AS n0, count(*) FILTER (stage = 1) AS n1, avg(x) FILTER (stage = 0) AS x0, avg(y) FILTER (stage = 0) AS y0, avg(z) FILTER (stage = 0) AS z0, avg(x) FILTER (stage = 1) AS x1, avg(y) FILTER (stage = 1) AS y1, avg(z) FILTER (stage = 1) AS z1 FROM points GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY state) AS k FROM g WHERE n0 > 0 AND n1 > 0), c AS (SELECT a.k AS i, b.k AS j, pow(a.x0 - b.x1, 2) + pow(a.y0 - b.y1, 2) + pow(a.z0 - b.z1, 2) AS c FROM s a, s b), h AS (SELECT median(c) AS h FROM c),
m AS (SELECT list(r ORDER BY i) AS m, count(*) AS n FROM (SELECT i, list(c / h ORDER BY j) AS r FROM c, h GROUP BY i)), p AS (SELECT list(ln(n0 / (SELECT sum(n0) FROM s)) ORDER BY k) AS la, list(ln(n1 / (SELECT sum(n1) FROM s)) ORDER BY k) AS lb FROM s),
it AS (SELECT 0 AS round, list_transform(la, lambda x: 0.0::DOUBLE) AS f, list_transform(lb, lambda x: 0.0::DOUBLE) AS g FROM p UNION ALL
SELECT round + 1, nf, list_transform(range(1, n + 1), lambda j: {factor} * (lb[j] - {soft("list_transform(range(1, n + 1), lambda i: (nf[i] - m[i][j]) / 0.1)")})) FROM (
SELECT *, list_transform(range(1, n + 1), lambda i: {factor} * (la[i] - {soft("list_transform(range(1, n + 1), lambda j: (g[j] - m[i][j]) / 0.1)")})) AS nf FROM it, m, p WHERE round < 400))
SELECT a.state AS src, b.state AS dst, round(exp((f[a.k] + g[b.k] - m[a.k][b.k]) / 0.1), 6) + 0.0 AS mass FROM it, m, s a, s b WHERE round = 400"""


@query(_coupling_sql(1.0))
def o2_unbalanced_coupling(t: Tables) -> DataFrame:
    """States of both stages coupled where their shares may grow or shrink."""
    return couplings.coupled(*_state_tables(t), 0.1, rho=(1.0, 1.0)).select(F.col("i").alias("src"), F.col("j").alias("dst"), r("mass").alias("mass"))


@query(_coupling_sql(None))
def o1_state_coupling(t: Tables) -> DataFrame:
    """States of both stages coupled, their shares kept."""
    return couplings.coupled(*_state_tables(t), 0.1).select(F.col("i").alias("src"), F.col("j").alias("dst"), r("mass").alias("mass"))


@query(f"WITH {EXPR}, n AS (SELECT state, count(*) FILTER (stage = 0) AS n0 FROM cells GROUP BY 1), c AS (SELECT a.state AS src, b.state AS dst, a.n0 * exp(-abs(a.state - b.state)) AS mass FROM n a, n b), m AS (SELECT state, gene, avg(v) AS m FROM expr WHERE stage = 0 GROUP BY ALL) SELECT dst, gene, round(sum(mass * m) / sum(mass), 8) + 0.0 AS v FROM c JOIN m ON src = state GROUP BY ALL")
def o5_o6_barycentric(t: Tables) -> DataFrame:
    n = t.cells().groupBy("state").agg(F.count_if(F.col("stage") == 0).alias("n0"))
    other = n.select(F.col("state").alias("dst"))
    c = n.crossJoin(F.broadcast(other)).select("state", "dst", (F.col("n0") * F.exp(-F.abs(F.col("state") - F.col("dst")))).alias("mass"))
    m = t.expr().where("stage = 0").groupBy("state", "gene").agg(F.avg("v").alias("m"))
    return c.join(m, "state").groupBy("dst", "gene").agg(r(F.sum(F.col("mass") * F.col("m")) / F.sum("mass"), 8).alias("v"))


@query("WITH k AS (SELECT event_type, abs(value - 50) AS s, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50), event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(s, 6) + 0.0 AS radius FROM k WHERE k = least(n, ceil((n + 1) * 0.9))")
def o11_conformal_radius(t: Tables) -> DataFrame:
    from cairn.operators.ranks import order_statistics

    e = t("events").withColumn("s", F.abs(F.col("value") - 50))
    return order_statistics(e, ["event_type"], "s", 0.9, {"radius": lambda n: F.least(n, F.ceil((n + 1) * 0.9))}).select("event_type", r("radius").alias("radius"))


@query("WITH p AS (SELECT event_type, event_id % 8 AS part, avg(value) - 50 AS m FROM events GROUP BY ALL), s AS (SELECT event_type, avg(m) AS mu, var_samp(m) AS v, min(m) AS lo, max(m) AS hi, avg(sign(m)) AS agree FROM p GROUP BY 1) SELECT event_type, round(mu * mu / (mu * mu + v), 6) + 0.0 AS weight, lo * hi > 0 AS same_sign, round(abs(agree), 6) + 0.0 AS stability FROM s")
def o13_o14_stability_weights(t: Tables) -> DataFrame:
    p = t("events").groupBy("event_type", (F.col("event_id") % 8).alias("part")).agg((F.avg("value") - 50).alias("m"))
    s = p.groupBy("event_type").agg(F.avg("m").alias("mu"), F.var_samp("m").alias("v"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.avg(F.signum("m")).alias("agree"))
    return s.select("event_type", r(F.col("mu") * F.col("mu") / (F.col("mu") * F.col("mu") + F.col("v"))).alias("weight"), (F.col("lo") * F.col("hi") > 0).alias("same_sign"), r(F.abs("agree")).alias("stability"))


@query()
def j15_assignment(t: Tables) -> DataFrame:
    """Points of both stages of a state matched at the least total squared distance, all of the smaller side; a state is solved in one task."""
    import pandas as pd

    def matched(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g[g.stage == s].sort_values("cell") for s in (0, 1))
        p, q = (v[["x", "y", "z"]].to_numpy() for v in (a, b))
        i, j = np.arange(min(len(p), len(q))), np.arange(min(len(p), len(q)))
        if len(a) <= len(b):
            j = geometry.assignment(geometry.SquaredGaps(p, q)) if len(a) else j
        else:
            i = geometry.assignment(geometry.SquaredGaps(q, p)) if len(b) else i
        return pd.DataFrame({"src": a.cell.to_numpy()[i], "dst": b.cell.to_numpy()[j], "cost": ((p[i] - q[j]) ** 2).sum(1).round(8)})

    return t.points().groupBy("state").applyInPandas(matched, "src long, dst long, cost double")


@query(_NN + " SELECT src, s.gene, round((v + m) / 2, 8) + 0.0 AS smooth FROM (SELECT src, b.gene, sum(w * b.v) / sum(w) AS m FROM (SELECT *, exp((pow(min(dist) OVER (PARTITION BY src), 2) - dist * dist) / 0.02) AS w FROM n WHERE src <> dst) n JOIN expr b ON b.cell = dst GROUP BY 1, 2) s JOIN expr a ON a.cell = src AND a.gene = s.gene")
def x19_neighbour_smooth(t: Tables) -> DataFrame:
    """Each value half its own, half the mean of its neighbours, weighted by distance against the nearest one's."""
    e = t.expr()
    nearest = F.min("dist").over(Window.partitionBy("src"))
    near = _near(t).where("src <> dst").withColumn("w", F.exp((nearest * nearest - F.col("dist") * F.col("dist")) / 0.02))
    n = near.join(e.select(F.col("cell").alias("dst"), "gene", F.col("v").alias("b")), "dst")
    m = n.groupBy("src", "gene").agg((F.sum(F.col("w") * F.col("b")) / F.sum("w")).alias("m"))
    return m.join(e.select(F.col("cell").alias("src"), "gene", "v"), ["src", "gene"]).select("src", "gene", r((F.col("v") + F.col("m")) / 2, 8).alias("smooth"))


_SIDES = f"WITH {EXPR}, {POINTS}, d AS (SELECT a.cell AS src, b.cell AS dst, b.stage AS side, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM points a JOIN points b ON a.state = b.state AND a.cell <> b.cell), n AS (SELECT src, dst, side FROM (SELECT *, row_number() OVER (PARTITION BY src, side ORDER BY round(dist, 9), dst) AS k FROM d) WHERE k <= 3)"


@query(_SIDES + ", m AS (SELECT src, side, gene, avg(v) AS m FROM n JOIN expr ON dst = cell GROUP BY ALL) SELECT src, gene, round(coalesce(0.7 * max(m) FILTER (side = 0) + 0.3 * max(m) FILTER (side = 1), max(m)), 8) + 0.0 AS expected FROM m GROUP BY 1, 2")
def x20_position_reference(t: Tables) -> DataFrame:
    """What is expected at a cell's place: its nearest cells of either stage, their means mixed 7 to 3; of one stage alone where the other has none."""
    p, e = t.points(), t.expr().select(F.col("cell").alias("dst"), "gene", "v")
    # Twice as a group of its own for each side: asked by all cells, answered by the side's.
    near = [joins.neighbours_among(p, p.where(F.col("stage") == s), 3, ["state"]).select("src", "dst", F.lit(s).alias("side")) for s in (0, 1)]
    m = near[0].unionByName(near[1]).join(e, "dst").groupBy("src", "side", "gene").agg(F.avg("v").alias("m"))
    left, right = (F.max(F.when(F.col("side") == s, F.col("m"))) for s in (0, 1))
    return m.groupBy("src", "gene").agg(r(F.coalesce(0.7 * left + 0.3 * right, F.max("m")), 8).alias("expected"))


@query(_NN + ", l AS (SELECT cell, state, v - avg(v) OVER (PARTITION BY state) AS d FROM expr WHERE gene = 2), g AS (SELECT cell FROM expr WHERE gene = 4 AND v > 0) SELECT a.cell, round(CASE WHEN a.cell IN (SELECT cell FROM g) THEN coalesce(sum(l.d / (1 + dist)), 0) ELSE 0 END, 8) + 0.0 AS signal FROM cells a LEFT JOIN (SELECT * FROM n WHERE src <> dst) n ON n.src = a.cell LEFT JOIN l ON l.cell = dst GROUP BY a.cell")
def x16_spatial_signal(t: Tables) -> DataFrame:
    """Changes of a ligand (gene 2, against its state) at a cell's neighbours, weighted by nearness, where the cell has the receptor (gene 4)."""
    e = t.expr()
    ligand = e.where("gene = 2").withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("state"))).select(F.col("cell").alias("dst"), "d")
    sums = _near(t).where("src <> dst").join(ligand, "dst").groupBy(F.col("src").alias("cell")).agg(F.sum(F.col("d") / (1 + F.col("dist"))).alias("s"))
    gate = e.where("gene = 4").select("cell", (F.col("v") > 0).alias("open"))
    return gate.join(sums, "cell", "left").select("cell", r(F.when(F.col("open"), F.coalesce("s", F.lit(0.0))).otherwise(0.0), 8).alias("signal"))


@query(_NN + ", dg AS (SELECT src, state, count(*) AS deg FROM n JOIN cells ON cell = src WHERE src <> dst GROUP BY ALL), mx AS (SELECT state, max(deg) AS top FROM dg GROUP BY 1) SELECT src, a.gene, round(a.v + 0.5 / max(top) * sum(b.v - a.v), 8) + 0.0 AS v FROM n JOIN expr a ON a.cell = src JOIN expr b ON b.cell = dst AND b.gene = a.gene JOIN mx ON mx.state = a.state WHERE src <> dst GROUP BY src, a.gene, a.v")
def x17_graph_diffusion(t: Tables) -> DataFrame:
    """One step of each gene towards its neighbours, by the largest degree of the state."""
    e = t.expr()
    n = _near(t).where("src <> dst")
    top = n.groupBy("state", "src").agg(F.count("*").alias("deg")).groupBy("state").agg(F.max("deg").alias("top"))
    rows = n.join(top, "state").join(e.select(F.col("cell").alias("src"), "gene", F.col("v").alias("a")), "src").join(e.select(F.col("cell").alias("dst"), "gene", F.col("v").alias("b")), ["dst", "gene"])
    return rows.groupBy("src", "gene", "a").agg((F.col("a") + 0.5 / F.max("top") * F.sum(F.col("b") - F.col("a"))).alias("v")).select("src", "gene", r("v", 8).alias("v"))
