"""Queries of further transports, forecasts and verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import alloc, fits, geometry, graphs, joins, metrics, transforms
from cairn.operators import moments as mo
from cairn.operators.lineage import settled
from cairn.sources import readers

from .registry import CELLS, EXPR, POINTS, Tables, query, r

_LIB = f"WITH {EXPR}, lib AS (SELECT cell, round(sum(v), 9) AS library FROM expr GROUP BY 1), e AS (SELECT * FROM expr JOIN lib USING (cell))"
_AT = "l[la + 1] + (pa - la) * (l[least(la + 1, len(l) - 1) + 1] - l[la + 1])"


def _with_library(t: Tables) -> DataFrame:
    e = t.expr()
    return e.join(e.groupBy("cell").agg(F.round(F.sum("v"), 9).alias("library")), "cell")


@query(f"WITH {EXPR}, q AS (SELECT state, gene, [quantile_cont(v, 0.1) FILTER (stage = 0 AND v > 0), quantile_cont(v, 0.5) FILTER (stage = 0 AND v > 0), quantile_cont(v, 0.9) FILTER (stage = 0 AND v > 0)] AS a, [quantile_cont(v, 0.1) FILTER (stage = 1 AND v > 0), quantile_cont(v, 0.5) FILTER (stage = 1 AND v > 0), quantile_cont(v, 0.9) FILTER (stage = 1 AND v > 0)] AS b FROM expr GROUP BY ALL), j AS (SELECT cell, gene, v, a, [least(greatest(ln(b[1] / a[1]), -0.5), 0.5), least(greatest(ln(b[2] / a[2]), -0.5), 0.5), least(greatest(ln(b[3] / a[3]), -0.5), 0.5)] AS s, CASE WHEN a[3] <= v THEN 3 WHEN a[2] <= v THEN 2 ELSE 1 END AS k FROM expr JOIN q USING (state, gene) WHERE stage = 0 AND v > 0 AND a[1] IS NOT NULL AND b[1] IS NOT NULL) SELECT cell, gene, round(v * exp(s[k] + CASE WHEN a[least(k + 1, 3)] > a[k] THEN least(greatest((v - a[k]) / (a[least(k + 1, 3)] - a[k]), 0), 1) ELSE 0 END * (s[least(k + 1, 3)] - s[k])), 6) + 0.0 AS moved FROM j")
def w11_positive_transport(t: Tables) -> DataFrame:
    return transforms.positive_transport(t.expr(), [0.1, 0.5, 0.9], 0.5).select("cell", "gene", r("moved").alias("moved"))


@query(_LIB + f", l AS (SELECT state, gene, list(v ORDER BY v) AS l FROM e WHERE stage = 1 GROUP BY ALL), u AS (SELECT *, (row_number() OVER (PARTITION BY state, gene ORDER BY v, library, cell) - 0.5) / count(*) OVER (PARTITION BY state, gene) AS u FROM e WHERE stage = 0), p AS (SELECT *, least(greatest(u * len(l) - 0.5, 0), len(l) - 1) AS pa FROM u JOIN l USING (state, gene)), q AS (SELECT *, CAST(floor(pa) AS BIGINT) AS la FROM p) SELECT cell, gene, round({_AT}, 6) + 0.0 AS moved FROM q")
def w12_zero_aware_transport(t: Tables) -> DataFrame:
    return transforms.zero_aware_transport(_with_library(t)).select("cell", "gene", r("moved").alias("moved"))


@query(_LIB + ", p AS (SELECT state, gene, 0.6 * avg((v > 0)::INT) FILTER (stage = 0) + 0.4 * avg((v > 0)::INT) FILTER (stage = 1) AS p FROM e GROUP BY ALL), s AS (SELECT state, gene, list(v ORDER BY v) FILTER (stage = 0 AND v > 0) AS l, list(v ORDER BY v) FILTER (stage = 1 AND v > 0) AS rl FROM e GROUP BY ALL), k AS (SELECT e.cell, e.state, e.gene, l, rl, row_number() OVER w AS k, round(p * count(*) OVER (PARTITION BY state, gene)) AS m FROM e JOIN p USING (state, gene) JOIN s USING (state, gene) WHERE stage = 0 AND l IS NOT NULL AND rl IS NOT NULL WINDOW w AS (PARTITION BY state, gene ORDER BY v DESC, library DESC, cell)), u AS (SELECT *, (m - k + 0.5) / m AS u FROM k), x AS (SELECT *, least(greatest(u * len(l) - 0.5, 0), len(l) - 1) AS pa, least(greatest(u * len(rl) - 0.5, 0), len(rl) - 1) AS pb FROM u), y AS (SELECT *, CAST(floor(pa) AS BIGINT) AS la, CAST(floor(pb) AS BIGINT) AS lb FROM x) SELECT state, gene, count(*) FILTER (k <= m) AS positives, round(sum(CASE WHEN k <= m THEN 0.6 * (" + _AT + ") + 0.4 * (rl[lb + 1] + (pb - lb) * (rl[least(lb + 1, len(rl) - 1) + 1] - rl[lb + 1])) ELSE 0 END), 6) + 0.0 AS total FROM y GROUP BY ALL")
def w14_w16_hurdle_margins(t: Tables) -> DataFrame:
    rows = transforms.hurdle_margins(_with_library(t), 0.4)
    return rows.groupBy("state", "gene").agg(F.count_if(F.col("decoded") > 0).alias("positives"), r(F.sum("decoded")).alias("total"))


@query(f"WITH {EXPR}, e AS (SELECT *, greatest(v + (cell % 7 - 3) / 50.0, 0.01) AS s FROM expr WHERE v > 0), k AS (SELECT *, row_number() OVER (PARTITION BY state, gene ORDER BY v, cell) AS k0, row_number() OVER (PARTITION BY state, gene ORDER BY s, cell) AS k1 FROM e) SELECT a.cell, a.gene, round(b.s, 6) + 0.0 AS repaired FROM k a JOIN k b ON a.state = b.state AND a.gene = b.gene AND a.k0 = b.k1")
def w17_positive_displacement(t: Tables) -> DataFrame:
    rows = t.expr().where("v > 0").withColumn("d", (F.col("cell") % 7 - 3) / 50)
    return transforms.displaced(rows, ["state", "gene"], "v", "d", 0.01, "cell").select("cell", "gene", r("repaired").alias("repaired"))


@query(f"WITH {EXPR}, m AS (SELECT state, gene, avg(v) FILTER (cell % 3 = 0) AS l, avg(v) FILTER (cell % 3 = 1) AS rr, avg((v > 0)::INT) FILTER (cell % 3 = 0) AS p FROM expr GROUP BY ALL) SELECT state, gene, round(avg(CASE WHEN v > 0 AND p > 0 THEN greatest(v + 0.4 * (rr - l) / p, 0) ELSE v END), 8) + 0.0 AS mean FROM expr JOIN m USING (state, gene) WHERE cell % 3 = 0 AND rr IS NOT NULL GROUP BY ALL")
def x4_interpolation_bridge(t: Tables) -> DataFrame:
    from cairn.operators.matrix import zero_preserving_shift

    e = t.expr()
    on = lambda k, c: F.avg(F.when(F.col("cell") % 3 == k, c))
    m = e.groupBy("state", "gene").agg(on(0, F.col("v")).alias("l"), on(1, F.col("v")).alias("r"), on(0, (F.col("v") > 0).cast("double")).alias("detected"))
    shifts = m.where("r is not null").select("state", "gene", (0.4 * (F.col("r") - F.col("l"))).alias("delta"), "detected")
    rows = zero_preserving_shift(e.where("cell % 3 = 0").join(shifts.select("state", "gene"), ["state", "gene"], "left_semi"), shifts, ["state", "gene"])
    return mo.pseudobulk(rows, ["state"]).select("state", "gene", r("mean", 8).alias("mean"))


@query(f"WITH {CELLS}, n AS (SELECT state, count(*) FILTER (stage = 0) AS n0, count(*) FILTER (stage = 1) AS n1 FROM cells GROUP BY 1), c AS (SELECT a.state AS src, b.state AS dst, a.n0 * exp(-abs(a.state - b.state)) AS mass FROM n a, n b), m AS (SELECT dst, sum(mass * least(greatest(n1 / n0, 1 / 1.5), 1.5)) AS m FROM c JOIN n ON src = state GROUP BY 1) SELECT dst, round(m / sum(m) OVER (), 8) + 0.0 AS share FROM m")
def x10_state_mass_forecast(t: Tables) -> DataFrame:
    n = t.cells().groupBy("state").agg(F.count_if(F.col("stage") == 0).alias("n0"), F.count_if(F.col("stage") == 1).alias("n1"))
    c = n.select(F.col("state").alias("src"), "n0").crossJoin(F.broadcast(n.select(F.col("state").alias("dst"))))
    c = c.select("src", "dst", (F.col("n0") * F.exp(-F.abs(F.col("src") - F.col("dst")))).alias("mass"))
    return transforms.coupled_mass(c, n.select(F.col("state").alias("src"), (F.col("n1") / F.col("n0")).alias("growth")), 1.5).select("dst", r("share", 8).alias("share"))


@query(f"WITH {EXPR}, m AS (SELECT state, stage, gene, avg(v) AS m FROM expr GROUP BY ALL), w AS (SELECT state AS src, (state + 1) % 10 AS dst FROM cells GROUP BY 1) SELECT src, a.gene, round(b.m - a.m, 8) + 0.0 AS delta FROM w JOIN m a ON a.state = src AND a.stage = 0 JOIN m b ON b.state = dst AND b.stage = 1 AND a.gene = b.gene")
def x11_crosswalk_delta(t: Tables) -> DataFrame:
    m = t.expr().groupBy("state", "stage", "gene").agg(F.avg("v").alias("m"))
    a = m.where("stage = 0").select(F.col("state").alias("src"), ((F.col("state") + 1) % 10).alias("dst"), "gene", F.col("m").alias("m0"))
    b = m.where("stage = 1").select(F.col("state").alias("dst"), "gene", F.col("m").alias("m1"))
    return a.join(b, ["dst", "gene"]).select("src", "gene", r(F.col("m1") - F.col("m0"), 8).alias("delta"))


@query(f"WITH {EXPR}, d AS (SELECT state, gene, abs(avg(v) FILTER (stage = 1) - avg(v) FILTER (stage = 0)) AS d FROM expr GROUP BY ALL) SELECT state, count(*) FILTER (d > 0.02) AS k, round(quantile_cont(d, 0.5) FILTER (d > 0.02), 8) + 0.0 AS median, round(quantile_cont(d, 0.9) FILTER (d > 0.02), 8) + 0.0 AS q90 FROM d GROUP BY 1")
def x15_effect_budget(t: Tables) -> DataFrame:
    on = lambda s: F.avg(F.when(F.col("stage") == s, F.col("v")))
    d = t.expr().groupBy("state", "gene").agg(F.abs(on(1) - on(0)).alias("d"))
    big = F.when(F.col("d") > 0.02, F.col("d"))
    return d.groupBy("state").agg(F.count(big).alias("k"), r(F.percentile(big, F.lit(0.5)), 8).alias("median"), r(F.percentile(big, F.lit(0.9)), 8).alias("q90"))


@query("WITH b AS (SELECT DISTINCT n_regionkey AS a, n_nationkey % 7 AS b FROM nation WHERE n_nationkey < 15), e AS (SELECT DISTINCT n_regionkey AS a, n_nationkey % 6 AS b FROM nation) SELECT a, b, 'base' AS origin FROM b UNION ALL SELECT a, b, 'added' FROM (SELECT * FROM e EXCEPT SELECT * FROM b)")
def x25_edge_augment(t: Tables) -> DataFrame:
    n = t("nation")
    base = n.where("n_nationkey < 15").select(F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 7).alias("b")).distinct()
    more = n.select(F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 6).alias("b")).distinct()
    return base.withColumn("origin", F.lit("base")).unionByName(more.join(base, ["a", "b"], "left_anti").withColumn("origin", F.lit("added")))


@query("WITH s AS (SELECT user_id, event_id, round(value / 100, 6) AS s, row_number() OVER (PARTITION BY user_id ORDER BY round(value / 100, 6) DESC, event_id) AS k FROM events), e AS (SELECT *, exp((s - max(s) OVER (PARTITION BY user_id)) / 0.1) AS e FROM s WHERE k <= 5) SELECT user_id, event_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) + 0.0 AS weight FROM e")
def t7_softmax_votes(t: Tables) -> DataFrame:
    rows = t("events").withColumn("s", F.round(F.col("value") / 100, 6))
    return transforms.softmax_votes(rows, "user_id", "s", "event_id", 5, 0.1).select("user_id", "event_id", r("weight").alias("weight"))


@query("WITH RECURSIVE e AS (SELECT l_suppkey AS src, l_partkey AS dst, max(round(l_extendedprice, 2)) AS score FROM lineitem GROUP BY ALL), s AS (SELECT 1 AS node, 0 AS layer UNION SELECT dst, layer + 1 FROM s JOIN e ON src = node WHERE layer < 3), l AS (SELECT node, min(layer) AS layer FROM s GROUP BY 1), k AS (SELECT e.*, a.layer AS layer_src, b.layer AS layer_dst, row_number() OVER (PARTITION BY dst ORDER BY score DESC, src) AS k FROM e JOIN l a ON a.node = src JOIN l b ON b.node = dst WHERE b.layer > a.layer) SELECT src, dst, score + 0.0 AS score, layer_src, layer_dst FROM k WHERE k <= 2")
def y14_layered_graph(t: Tables) -> DataFrame:
    e = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.round("l_extendedprice", 2).alias("score"))
    roots = t.spark.sql("SELECT 1L AS node")
    return transforms.layers(e, roots, 3, 2).select("src", "dst", r("score", 2).alias("score"), "layer_src", "layer_dst")


@query(f"WITH {POINTS}, l AS (SELECT list(x ORDER BY x) FILTER (stage = 0) AS l, list(x ORDER BY x) FILTER (stage = 1) AS rl FROM points), u AS (SELECT cell, l, rl, (row_number() OVER (ORDER BY x, cell) - 0.5) / count(*) OVER () AS u FROM points, l WHERE stage = 0), p AS (SELECT *, least(greatest(u * len(l) - 0.5, 0), len(l) - 1) AS pa, least(greatest(u * len(rl) - 0.5, 0), len(rl) - 1) AS pb FROM u), q AS (SELECT *, CAST(floor(pa + 1e-9) AS BIGINT) AS la, CAST(floor(pb + 1e-9) AS BIGINT) AS lb FROM p) SELECT cell, round(0.5 * ({_AT}) + 0.5 * (rl[lb + 1] + (pb - lb) * (rl[least(lb + 1, len(rl) - 1) + 1] - rl[lb + 1])), 6) + 0.0 AS warped FROM q")
def y6_axis_warp(t: Tables) -> DataFrame:
    return transforms.axis_warp(t.points(), "x", 0.5).select("cell", r("warped").alias("warped"))


@query("WITH g AS (SELECT event_type, regr_slope(ln(value + 1), event_id % 12) AS a, regr_intercept(ln(value + 1), event_id % 12) AS b, exp(avg(ln(value + 1))) AS ref FROM events GROUP BY 1) SELECT event_type, exp(a * 40 + b) / ref NOT BETWEEN 0.97 AND 1.03 AS held, round(CASE WHEN exp(a * 40 + b) / ref NOT BETWEEN 0.97 AND 1.03 THEN ref ELSE exp(a * 40 + b) END, 5) + 0.0 AS value FROM g")
def y7_held_trend(t: Tables) -> DataFrame:
    rows = t("events").select("event_type", (F.col("event_id") % 12).cast("double").alias("x"), (F.col("value") + 1).alias("y"))
    return transforms.held_trend(rows, ["event_type"], "x", "y", 40.0, 0.97, 1.03).select("event_type", "held", r("value", 5).alias("value"))


@query("WITH d AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5('31:' || vec_id), vec_id) AS h, 20 + label * 12 AS quota FROM embeddings), m AS (SELECT *, greatest(quota - n, 0) AS m FROM d) SELECT label, vec_id, CAST((k <= quota)::BIGINT + m // n + CASE WHEN h <= m % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM m")
def y31_maximal_overlap(t: Tables) -> DataFrame:
    donors = t("embeddings").select("label", "vec_id")
    quota = donors.select("label").distinct().withColumn("quota", 20 + F.col("label") * 12)
    return transforms.maximal_overlap(donors, quota, "label", "vec_id", 31).select("label", "vec_id", F.col("copies").cast("long").alias("copies"))


@query(f"WITH {EXPR} SELECT cell, abs(sum(exp(v) - 1) - 1e4) <= 1 AS is_closed, sum(exp(v) - 1) > 0 AS has_mass, bool_and(v = floor(v)) AS whole_counts FROM expr GROUP BY 1")
def y3_log_scale_validation(t: Tables) -> DataFrame:
    mass = F.sum(F.expm1("v"))
    return t.expr().groupBy("cell").agg((F.abs(mass - 1e4) <= 1).alias("is_closed"), (mass > 0).alias("has_mass"), F.bool_and(F.col("v") == F.floor("v")).alias("whole_counts"))


@query(f"WITH {EXPR}, c AS (SELECT state, gene, avg(v) AS m FROM expr GROUP BY ALL), d AS (SELECT state, gene, m - avg(m) OVER (PARTITION BY state) AS d FROM c), p AS (SELECT a.state AS src, b.state AS dst, round(sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d)), 9) AS s FROM d a JOIN d b USING (gene) WHERE a.state <> b.state GROUP BY ALL) SELECT src, dst, k FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS k FROM p) WHERE k <= 3")
def y8_correlation_neighbours(t: Tables) -> DataFrame:
    c = t.expr().groupBy("state", "gene").agg(F.avg("v").alias("m"))
    d = c.withColumn("d", F.col("m") - F.avg("m").over(Window.partitionBy("state")))
    a, b = (d.select(F.col("state").alias(n), "gene", F.col("d").alias(f"d_{n}")) for n in ("src", "dst"))
    s = F.round(F.sum(F.col("d_src") * F.col("d_dst")) / F.sqrt(F.sum(F.col("d_src") * F.col("d_src")) * F.sum(F.col("d_dst") * F.col("d_dst"))), 9)
    p = a.join(b, "gene").where("src <> dst").groupBy("src", "dst").agg(s.alias("s"))
    k = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("s"), "dst"))
    return p.withColumn("k", k.cast("long")).where("k <= 3").select("src", "dst", "k")


_FLIPS = "f(f, sx, sy, sz) AS (VALUES (0, 1, 1, 1), (1, 1, -1, -1), (2, -1, 1, -1), (3, -1, -1, 1))"


@query(f"WITH {POINTS}, {_FLIPS}, q AS (SELECT a.state, f.f, a.cell AS c0, b.cell AS c1, sqrt(pow(a.x - f.sx * b.x, 2) + pow(a.y - f.sy * b.y, 2) + pow(a.z - f.sz * b.z, 2)) AS d FROM points a JOIN points b ON a.state = b.state AND a.stage = 0 AND b.stage = 1, f), d AS (SELECT state, f, 0 AS side, c0 AS cell, min(d) AS d FROM q GROUP BY ALL UNION ALL SELECT state, f, 1, c1, min(d) FROM q GROUP BY ALL), e AS (SELECT state, f, side, avg(d) AS m FROM d GROUP BY ALL), m AS (SELECT state, f, round(sum(m) / 2, 8) AS m FROM e GROUP BY ALL) SELECT state, CAST(arg_min(f, (m, f)) AS INTEGER) AS flip, min(m) + 0.0 AS chamfer, CASE WHEN min(m) > 0.12 THEN 'CATASTROPHIC' WHEN min(m) > 0.1 THEN 'DISRUPTIVE' ELSE 'PASS' END AS verdict FROM m GROUP BY 1")
def q18_q25_axis_flips(t: Tables) -> DataFrame:
    """The proper flip of stage 1 that brings it nearest to stage 0: mean distance to the nearest point, both ways."""
    flips = t.spark.sql("SELECT * FROM VALUES (0, 1, 1, 1), (1, 1, -1, -1), (2, -1, 1, -1), (3, -1, -1, 1) AS f(f, sx, sy, sz)")
    every = t.points().crossJoin(F.broadcast(flips))
    still = every.where("stage = 0").select("state", "f", "cell", *"xyz")
    turned = every.where("stage = 1").select("state", "f", "cell", *((F.col(c) * F.col(f"s{c}")).alias(c) for c in "xyz"))
    ways = [joins.neighbours_among(a, b, 1, ["state", "f"]).groupBy("state", "f").agg(F.avg("dist").alias(n)) for a, b, n in ((still, turned, "there"), (turned, still, "back"))]
    m = ways[0].join(ways[1], ["state", "f"]).withColumn("m", F.round((F.col("there") + F.col("back")) / 2, 8))
    g = m.groupBy("state").agg(F.min_by("f", F.struct("m", "f")).alias("flip"), (F.min("m") + 0.0).alias("chamfer"))
    return g.withColumn("verdict", F.when(F.col("chamfer") > 0.12, "CATASTROPHIC").when(F.col("chamfer") > 0.1, "DISRUPTIVE").otherwise("PASS"))


def _kernel_distance(cells: DataFrame) -> DataFrame:
    """Of each state: unbiased squared MMD between stages (cell, state, stage, x) on 30 principal components of all cells of
    stage 1, five kernel widths around their median. Defined on 2,000 cells a side at most, the first by hash."""
    frames = fits.principal_frames(cells.where("stage = 1").withColumn("by", F.col("state")), 30)
    s = alloc.stratified(cells, ["state", "stage"], "cell", 2000, 0)

    def distance(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(v.to_list()) if len(v) > 1 else None for v in (g[g.stage == k].sort_values("cell").x for k in (0, 1)))
        return pd.DataFrame({"state": [g.state.iloc[0]], "mmd": [round(metrics.kernel_distance(a, b, *frames[g.state.iloc[0]]), 8) if a is not None and b is not None else None]})

    return s.groupBy("state").applyInPandas(distance, "state int, mmd double")


@query()
def q6_kernel_distance(t: Tables) -> DataFrame:
    return _kernel_distance(t.cells())


@query()
def q15b_neighbourhood_kernel_distance(t: Tables) -> DataFrame:
    """The same between neighbourhoods: each cell the mean of itself and its four nearest of its own stage and state."""
    near = joins.neighbours(t.points(), 5, ["state", "stage"], keep_self=True)
    e = t.expr().select(F.col("cell").alias("dst"), "gene", "v")
    m = near.join(e, "dst").groupBy("state", "stage", F.col("src").alias("cell"), "gene").agg(F.avg("v").alias("m"))
    x = m.groupBy("state", "stage", "cell").agg(F.array_sort(F.collect_list(F.struct("gene", "m"))).alias("x"))
    return _kernel_distance(x.withColumn("x", F.col("x.m")))


@query()
def o4_exact_plan(t: Tables) -> DataFrame:
    """Exact transport between the cells of both stages of each state, with equal masses on either side; a state is solved in one task."""

    def plan(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g[g.stage == k].sort_values("cell") for k in (0, 1))
        p, q = (v[["x", "y", "z"]].to_numpy() for v in (a, b))
        i, j, mass = geometry.exact_plan(geometry.SquaredGaps(p, q), np.full(len(p), 1 / max(len(p), 1)), np.full(len(q), 1 / max(len(q), 1)))
        return pd.DataFrame({"src": a.cell.to_numpy()[i], "dst": b.cell.to_numpy()[j], "mass": mass.round(10)})

    # States are few and small, but long to solve: left to their size, several would share a task.
    return t.points().repartition(256, "state").groupBy("state").applyInPandas(plan, "src long, dst long, mass double")


@query(f"WITH RECURSIVE {POINTS}, d AS (SELECT a.state, a.cell AS src, b.cell AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM points a JOIN points b ON a.state = b.state AND a.stage = 0 AND b.stage = 1), n AS (SELECT state, src, dst, round(exp(-dist * dist / 0.05), 9) AS mass FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS k FROM d) WHERE k <= 8), p AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY mass DESC, src, dst) AS k FROM n), g AS (SELECT DISTINCT state, 0::BIGINT AS k, []::BIGINT[] AS us, []::BIGINT[] AS ud FROM p UNION ALL SELECT g.state, p.k, CASE WHEN list_contains(us, src) OR list_contains(ud, dst) THEN us ELSE list_append(us, src) END, CASE WHEN list_contains(us, src) OR list_contains(ud, dst) THEN ud ELSE list_append(ud, dst) END FROM g JOIN p ON p.state = g.state AND p.k = g.k + 1) SELECT unnest(us) AS src, unnest(ud) AS dst FROM (SELECT state, arg_max(us, k) AS us, arg_max(ud, k) AS ud FROM g GROUP BY 1)")
def o8_plan_permutation(t: Tables) -> DataFrame:
    """A plan between both stages of each state, from each cell to its eight nearest, as one-to-one pairs: the largest masses first."""
    p = t.points()
    near = joins.neighbours_among(p.where("stage = 0"), p.where("stage = 1"), 8, ["state"])
    return geometry.matched(near.select("src", "dst", F.round(F.exp(-F.col("dist") * F.col("dist") / 0.05), 9).alias("mass")))


_GRAPH = "d AS (SELECT a.state, a.cell AS src, b.cell AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM points a JOIN points b ON a.state = b.state AND a.cell <> b.cell), n AS (SELECT state, src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS k FROM d) WHERE k <= 6), sc AS (SELECT state, greatest(median(dist) FILTER (dist > 0), 1e-6) AS scale FROM n GROUP BY 1), h AS (SELECT src, dst, exp(-least(pow(dist / scale, 2), 700)) / 2 AS w FROM n JOIN sc USING (state)), e AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM h UNION ALL SELECT dst, src, w FROM h) GROUP BY ALL), deg AS (SELECT src, sum(w) AS d FROM e GROUP BY 1)"


@query(f"WITH RECURSIVE {POINTS}, {_GRAPH}, idx AS (SELECT cell, stage::DOUBLE AS y, row_number() OVER (ORDER BY cell) AS i FROM points), adj AS (SELECT list(nb ORDER BY i) AS a, list(y ORDER BY i) AS y, count(*) AS n FROM (SELECT u.i, any_value(u.y) AS y, list({{'j': v.i, 'w': e.w / d}}) AS nb FROM idx u JOIN e ON e.src = u.cell JOIN idx v ON v.cell = e.dst JOIN deg ON deg.src = u.cell GROUP BY u.i)), it AS (SELECT 0 AS k, y AS f FROM adj UNION ALL SELECT k + 1, list_transform(range(1, n + 1), lambda i: 0.8 * list_sum(list_transform(a[i], lambda q: q.w * f[q.j])) + 0.2 * y[i]) FROM it, adj WHERE k < 100) SELECT cell, round(least(greatest(f[i], 0), 1), 6) + 0.0 AS f FROM it, idx WHERE k = 100")
def x18_label_propagation(t: Tables) -> DataFrame:
    """How far each cell's neighbourhood is of stage 1: f = 0.8 D^-1 W f + 0.2 y on the symmetric neighbour graph of each state, a hundred rounds."""
    p = t.points()
    edges, _ = graphs.neighbour_graph(p, 6, ["state"])
    f = graphs.propagated_rounds(p.select("cell", F.col("stage").cast("double").alias("y")), settled(edges), 0.8, 100)
    return f.select("cell", r(F.least(F.greatest("f", F.lit(0.0)), F.lit(1.0))).alias("f"))


def _scaled(t: Tables, size: int) -> DataFrame:
    """cell, state, stage, z: the first values of each cell, scaled by their state's mean and spread over both stages."""
    c = t("embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("state"), (F.col("vec_id") % 2).alias("stage"), *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)))
    m = c.groupBy("state").agg(*(f(f"e{i}").alias(f"{n}{i}") for i in range(size) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))))
    z = F.array(*((F.col(f"e{i}") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i in range(size)))
    return c.join(m, "state").select("cell", "state", "stage", z.alias("z"))


@query()
def l5_soft_states(t: Tables) -> DataFrame:
    """Soft states within each state: mixtures of diagonal Gaussians, as many components as cells allow."""
    rows = settled(_scaled(t, 6).withColumnRenamed("state", "by"))
    models = fits.diagonal_mixtures(rows, 6, 20)
    out = fits.mixture_shares(rows, models)
    return out.select("cell", F.col("by").alias("state"), F.size("share").alias("components"), r(F.array_max("share"), 4).alias("weight"))


@query()
def a29_a30_position_ridge(t: Tables) -> DataFrame:
    """Ridge of each gene on coordinates, by state: normal equations are sums, solved one small system a group."""
    e = t.expr().join(t.points().select("cell", "x", "y", "z"), "cell")
    one = {"one": F.lit(1.0)}
    names = ["one", "x", "y", "z"]
    sums = e.withColumns(one).groupBy("state", "gene").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in names), *(F.sum(F.col(a) * F.col("v")).alias(f"{a}_v") for a in names))

    def solve(batches):
        for g in batches:
            a = np.array([[g[f"{i}_{j}"] for j in names] for i in names]).transpose(2, 0, 1) + 0.1 * np.diag([0, 1, 1, 1])
            b = np.array([g[f"{i}_v"] for i in names]).T
            w = np.linalg.solve(a, b[..., None])[..., 0].round(12)
            yield pd.DataFrame({"state": g.state, "gene": g.gene, "w0": w[:, 0], "wx": w[:, 1], "wy": w[:, 2], "wz": w[:, 3]})

    return sums.mapInPandas(solve, "state int, gene long, w0 double, wx double, wy double, wz double")


@query(f"WITH {EXPR}, {POINTS}, d AS (SELECT a.cell AS src, b.cell AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM points a JOIN points b ON a.state = b.state AND a.cell <> b.cell), n AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS k FROM d) WHERE k <= 4), g AS (SELECT state, gene, avg(v) AS m FROM expr GROUP BY 1, 2), q AS (SELECT cell, gene, v - m AS res, m FROM expr JOIN g USING (state, gene)) SELECT src AS cell, a.gene, round(max(a.m) + avg(b.res), 8) + 0.0 AS predicted FROM n JOIN q a ON a.cell = src JOIN q b ON b.cell = dst AND b.gene = a.gene GROUP BY 1, 2")
def y28_residual_neighbours(t: Tables) -> DataFrame:
    e = t.expr()
    q = e.join(e.groupBy("state", "gene").agg(F.avg("v").alias("m")), ["state", "gene"]).select("cell", "gene", (F.col("v") - F.col("m")).alias("res"), "m")
    n = joins.neighbours(t.points(), 4, ["state"]).select("src", "dst")
    rows = n.join(q.select(F.col("cell").alias("src"), "gene", "m"), "src").join(q.select(F.col("cell").alias("dst"), "gene", "res"), ["dst", "gene"])
    return rows.groupBy(F.col("src").alias("cell"), "gene").agg(r(F.max("m") + F.avg("res"), 8).alias("predicted"))


@query("SELECT 'f' || n_regionkey AS name, CASE WHEN n_regionkey = 4 THEN 'MISSING' WHEN n_regionkey = 3 THEN 'CHANGED' ELSE 'OK' END AS status FROM nation GROUP BY n_regionkey UNION ALL SELECT 'x', 'EXTRA'")
def v5_s21_hash_lock(t: Tables) -> DataFrame:
    names = t("nation").select("n_regionkey").distinct()
    content = lambda k: F.sha2(k.cast("string"), 256)
    want = names.select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("name"), content(F.col("n_regionkey")).alias("sha256"))
    got = names.where("n_regionkey < 4").select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("name"), content(F.when(F.col("n_regionkey") == 3, F.lit(99)).otherwise(F.col("n_regionkey"))).alias("sha256"))
    extra = t.spark.sql("SELECT 'x' AS name, 'z' AS sha256")
    return readers.locked(got.unionByName(extra), want)


@query(f"WITH {CELLS}, g AS (SELECT state, count(*) FILTER (stage = 0) >= 20 AS reports, count(*) FILTER (stage = 1) >= 20 AS bound FROM cells GROUP BY 1) SELECT state, CASE WHEN reports AND bound THEN 'PASS' WHEN reports THEN 'HOLD' ELSE 'REJECT' END AS gate, reports AND bound AS can_activate FROM g")
def v3_v8_route_gate(t: Tables) -> DataFrame:
    g = t.cells().groupBy("state").agg((F.count_if(F.col("stage") == 0) >= 20).alias("a"), (F.count_if(F.col("stage") == 1) >= 20).alias("b"))
    gate = F.when(F.col("a") & F.col("b"), "PASS").when(F.col("a"), "HOLD").otherwise("REJECT")
    return g.select("state", gate.alias("gate"), (F.col("a") & F.col("b")).alias("can_activate"))


@query(f"WITH {POINTS}, m AS (SELECT state, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(z) AS sz FROM points GROUP BY 1), s AS (SELECT state, stage, (x - mx) / sx AS x, (y - my) / sy AS y, (z - mz) / sz AS z FROM points JOIN m USING (state)), f AS (SELECT state, stage, unnest([x, y, z, x * x, y * y, z * z]) AS v, unnest(range(1, 7)) AS feature FROM s), g AS (SELECT state, feature, avg(v) FILTER (stage = 0) AS a, avg(v) FILTER (stage = 1) AS b FROM f GROUP BY ALL) SELECT state, CAST(feature AS INTEGER) AS feature, round(a + 0.5 * (b - a), 6) + 0.0 AS target, round(a + 0.5 * (b - a), 6) + 0.0 AS reached FROM g")
def o12_moment_tilt(t: Tables) -> DataFrame:
    """Weights exp(theta.f) of each state's cells of stage 0 that move the means of coordinates and their squares half way to
    stage 1: the target, and what the weights' mean (with the ridge's share) comes to over all cells."""
    rows = settled(_scaled(t, 3).withColumn("f", F.concat("z", F.transform("z", lambda v: v * v))).withColumnRenamed("state", "by"))
    means = rows.groupBy("by").agg(*(F.avg(F.when(F.col("stage") == s, F.col("f")[i])).alias(f"m{s}_{i}") for s in (0, 1) for i in range(6)))
    goals = {g["by"]: np.array([g[f"m0_{i}"] + 0.5 * (g[f"m1_{i}"] - g[f"m0_{i}"]) for i in range(6)]) for g in means.collect()}  # a row for each state
    found = fits.moment_tilt(rows.where("stage = 0"), goals, 0.01, 5.0)
    theta = t.spark.createDataFrame([(s, [float(v) for v in x[0]], [float(v) for v in goals[s]]) for s, x in found.items()], f"by {dict(rows.dtypes)['by']}, theta array<double>, goal array<double>")
    w = rows.where("stage = 0").join(theta, "by").withColumn("w", F.exp(F.aggregate(F.zip_with("f", "theta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
    long = w.select("by", "w", F.posexplode(F.arrays_zip("f", "theta", "goal")).alias("i", "q"))
    reached = F.sum(F.col("w") * F.col("q.f")) / F.sum("w") + 0.01 * F.max("q.theta")
    return long.groupBy(F.col("by").alias("state"), (F.col("i") + 1).alias("feature")).agg(r(F.max("q.goal")).alias("target"), r(reached).alias("reached"))


_AXES = "a AS (SELECT g AS gene, sqrt(2 / 64.0) * cos(pi() * (g - 0.5) / 64) AS a1, sqrt(2 / 64.0) * cos(2 * pi() * (g - 0.5) / 64) AS a2 FROM range(1, 65) r(g))"


def _axes() -> np.ndarray:
    """Two fixed axes of 64 genes, at right angles."""
    return np.sqrt(2 / 64) * np.cos(np.pi * (np.arange(64)[:, None] + 0.5) * np.array([1, 2]) / 64)


@query(f"WITH {EXPR}, {_AXES}, m AS (SELECT state, gene, avg(v) AS mx, avg((v > 0)::INT::DOUBLE) AS my FROM expr GROUP BY ALL), d AS (SELECT cell, state, gene, v - mx AS d, (v > 0)::INT - my AS y FROM expr JOIN m USING (state, gene)), z AS (SELECT cell, state, sum(d * a1) AS z1, sum(d * a2) AS z2 FROM d JOIN a USING (gene) GROUP BY ALL), zz AS (SELECT state, count(*) AS n, sum(z1 * z1) AS s11, sum(z1 * z2) AS s12, sum(z2 * z2) AS s22 FROM z GROUP BY 1), g AS (SELECT d.state, gene, sum(z1 * y) AS zy1, sum(z2 * y) AS zy2, sum(z1 * d) AS zx1, sum(z2 * d) AS zx2, sum(d * d) AS xx, sum(d * y) AS xy FROM d JOIN z USING (cell) GROUP BY ALL), c AS (SELECT *, s11 - 2 * zx1 * a1 + xx * a1 * a1 AS c11, s12 - zx1 * a2 - zx2 * a1 + xx * a1 * a2 AS c12, s22 - 2 * zx2 * a2 + xx * a2 * a2 AS c22, zy1 - a1 * xy AS r1, zy2 - a2 * xy AS r2 FROM g JOIN a USING (gene) JOIN zz USING (state)), p AS (SELECT *, c11 + 0.1 * greatest((c11 + c22) / 2, 1) AS q11, c22 + 0.1 * greatest((c11 + c22) / 2, 1) AS q22 FROM c), b AS (SELECT state, gene, n, a1, a2, (q22 * r1 - c12 * r2) / (q11 * q22 - c12 * c12) AS b1, (q11 * r2 - c12 * r1) / (q11 * q22 - c12 * c12) AS b2 FROM p) SELECT d.cell, d.gene, round(CASE WHEN n >= 20 THEN z1 * b1 + z2 * b2 - d * (a1 * b1 + a2 * b2) ELSE 0 END, 6) + 0.0 AS propensity FROM d JOIN z USING (cell) JOIN b ON b.state = d.state AND b.gene = d.gene")
def l8_detection_propensity(t: Tables) -> DataFrame:
    """How a cell's two components, without the gene's own part, foretell that it shows a gene."""
    out = fits.detection_propensity(t.cells(), _axes())
    return out.select("cell", F.posexplode("propensity").alias("gene", "p")).select("cell", (F.col("gene") + 1).cast("long").alias("gene"), r("p").alias("propensity"))


@query()
def l8_propensity_of_components(t: Tables) -> DataFrame:
    """The same by ten principal components of all cells."""
    out = fits.detection_propensity(t.cells(), fits.principal_axes(t.cells(), "x", 64, 10))
    return out.select("cell", F.transform("propensity", lambda v: r(v)).alias("propensity"))
