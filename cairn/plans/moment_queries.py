"""Queries of aggregations and transforms over them (2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import matrix, trends
from cairn.operators import moments as mo

from .registry import EXPR, POINTS, Tables, query, r


@query(f"WITH {EXPR} SELECT gene, round(avg(v), 8) + 0.0 AS mean FROM expr GROUP BY 1")
def a1_pseudobulk(t: Tables) -> DataFrame:
    return mo.pseudobulk(t.expr()).select("gene", r("mean", 8).alias("mean"))


@query(f"WITH {EXPR}, n AS (SELECT state, count(*) AS n FROM cells GROUP BY 1) SELECT state, gene, round(sum(v) / max(n), 8) + 0.0 AS mean, max(n) AS n_cells FROM expr JOIN n USING (state) WHERE v > 0 GROUP BY 1, 2")
def a2_sparse_means(t: Tables) -> DataFrame:
    return mo.sparse_means(t.expr().where("v > 0"), t.cells(), ["state"]).select("state", "gene", r("mean", 8).alias("mean"), "n_cells")


@query(f"WITH {EXPR} SELECT state, stage, gene, round(avg(v), 8) + 0.0 AS mean, round(var_pop(v), 8) + 0.0 AS var, count(*) AS n FROM expr GROUP BY ALL")
def a3_grouped_moments(t: Tables) -> DataFrame:
    return mo.grouped_moments(t.expr(), ["state", "stage"]).select("state", "stage", "gene", r("mean", 8).alias("mean"), r("var", 8).alias("var"), "n")


@query("SELECT event_type, day, n, round(n / sum(n) OVER (PARTITION BY day), 8) + 0.0 AS share FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)")
def a4_a5_shares(t: Tables) -> DataFrame:
    rows = t("events").withColumn("day", F.to_date("ts"))
    return mo.shares(rows, ["event_type"], ["day"]).select("event_type", "day", "n", r("share", 8).alias("share"))



def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(t("events").where(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.count("*").alias("n")) for k in (0, 1))


@query("WITH b AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS c0, count(*) FILTER (event_id % 2 = 1) AS c1 FROM events GROUP BY 1), w AS (SELECT sum(c0) AS s0, sum(c1) AS s1, count(*) AS k FROM b) SELECT event_type, round((c0 + 0.5) / (s0 + 0.5 * k), 8) + 0.0 AS p0, round((c1 + 0.5) / (s1 + 0.5 * k), 8) + 0.0 AS p1, round(least(greatest(0.8 * ln(((c1 + 0.5) / (s1 + 0.5 * k)) / ((c0 + 0.5) / (s0 + 0.5 * k))), -0.02), 0.02), 8) + 0.0 AS step FROM b, w")
def a6_smoothed_shares(t: Tables) -> DataFrame:
    return mo.smoothed_log_step(*_halves(t), "event_type", 0.5, 0.8, 0.02).select("event_type", r("p0", 8).alias("p0"), r("p1", 8).alias("p1"), r("step", 8).alias("step"))


@query("WITH b AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS c0, count(*) FILTER (event_id % 2 = 1) AS c1 FROM events GROUP BY 1), w AS (SELECT sum(c0) AS s0, sum(c1) AS s1, count(*) AS k FROM b), q AS (SELECT event_type, ln((c1 + 0.5) / (s1 + 0.5 * k)) - ln((c0 + 0.5) / (s0 + 0.5 * k)) AS raw FROM b, w) SELECT event_type, round(raw - avg(raw) OVER (), 8) + 0.0 AS log_ratio FROM q")
def a7_centred_log_ratio(t: Tables) -> DataFrame:
    return mo.centred_log_ratio(*_halves(t), "event_type").select("event_type", r("log_ratio", 8).alias("log_ratio"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) + 0.0 AS n, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 8) + 0.0 AS share FROM lineitem GROUP BY 1")
def a8_weighted_shares(t: Tables) -> DataFrame:
    return mo.shares(t("lineitem"), ["l_returnflag"], weight="l_extendedprice").select("l_returnflag", r("n", 2).alias("n"), r("share", 8).alias("share"))


@query(f"WITH {EXPR} SELECT state, gene, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END), 8) + 0.0 AS detected, round(avg(v) FILTER (v > 0), 8) + 0.0 AS positive_mean FROM expr GROUP BY ALL")
def a9_detection(t: Tables) -> DataFrame:
    return mo.detection(t.expr(), ["state", "gene"]).select("state", "gene", r("detected", 8).alias("detected"), r("positive_mean", 8).alias("positive_mean"))


@query(f"WITH {EXPR}, q AS (SELECT state, gene, count(*) AS n, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.9) AS c FROM expr WHERE v > 0 GROUP BY ALL) SELECT state, gene, n, CASE WHEN n >= 3 THEN round(a, 6) + 0.0 END AS q10, CASE WHEN n >= 3 THEN round(b, 6) + 0.0 END AS q50, CASE WHEN n >= 3 THEN round(c, 6) + 0.0 END AS q90 FROM q")
def a10_quantile_vector(t: Tables) -> DataFrame:
    rows = mo.quantile_vector(t.expr(), ["state", "gene"], [0.1, 0.5, 0.9])
    return rows.select("state", "gene", "n", *(r(F.col("q")[i]).alias(f"q{k}") for i, k in enumerate((10, 50, 90))))


@query(f"WITH {EXPR}, o AS (SELECT state, gene, quantile_cont(v, 0.5) FILTER (stage = 0) AS a0, quantile_cont(v, 0.5) FILTER (stage = 1) AS a1, quantile_cont(v, 0.9) FILTER (stage = 0) AS b0, quantile_cont(v, 0.9) FILTER (stage = 1) AS b1, least(count(*) FILTER (stage = 0), count(*) FILTER (stage = 1)) AS n FROM expr GROUP BY ALL), g AS (SELECT gene, quantile_cont(v, 0.5) FILTER (stage = 0) AS ga0, quantile_cont(v, 0.5) FILTER (stage = 1) AS ga1, quantile_cont(v, 0.9) FILTER (stage = 0) AS gb0, quantile_cont(v, 0.9) FILTER (stage = 1) AS gb1 FROM expr GROUP BY 1) SELECT state, gene, round(n / (n + 50.0), 8) + 0.0 AS weight, round(n / (n + 50.0) * (a1 - a0) + (1 - n / (n + 50.0)) * (ga1 - ga0), 6) + 0.0 AS median_response, round(n / (n + 50.0) * (b1 - b0) + (1 - n / (n + 50.0)) * (gb1 - gb0), 6) + 0.0 AS upper_response FROM o JOIN g USING (gene) WHERE n >= 10")
def a11_quantile_response(t: Tables) -> DataFrame:
    rows = mo.quantile_response(t.expr(), [0.5, 0.9], 50.0, 10)
    return rows.select("state", "gene", r("weight", 8).alias("weight"), r(F.col("response")[0]).alias("median_response"), r(F.col("response")[1]).alias("upper_response"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.5) AS m, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS i, stddev_pop(value) AS s FROM events GROUP BY 1), d AS (SELECT event_type, 1.4826 * quantile_cont(abs(value - m), 0.5) AS d FROM events JOIN q USING (event_type) GROUP BY 1) SELECT event_type, round(m, 6) + 0.0 AS median, round(d, 6) + 0.0 AS mad, round(i, 6) + 0.0 AS iqr_sd, round(CASE WHEN d > 0 THEN d WHEN i > 0 THEN i ELSE s END, 6) + 0.0 AS spread FROM q JOIN d USING (event_type)")
def a12_robust_spread(t: Tables) -> DataFrame:
    return mo.robust_spread(t("events"), "value", ["event_type"]).select("event_type", *(r(c).alias(c) for c in ("median", "mad", "iqr_sd", "spread")))


@query(f"WITH {EXPR}, n AS (SELECT cell, sqrt(sum(v * v)) AS n FROM expr GROUP BY 1), c AS (SELECT state, gene, avg(v / CASE WHEN n > 0 THEN n ELSE 1 END) AS m FROM expr JOIN n USING (cell) GROUP BY ALL), s AS (SELECT state, sqrt(sum(m * m)) AS s FROM c GROUP BY 1) SELECT state, gene, round(m / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS centroid FROM c JOIN s USING (state)")
def a13_centroids(t: Tables) -> DataFrame:
    return matrix.to_long(trends.centroids(t.cells()), "centroid", ("state",)).select("state", "gene", r("v").alias("centroid"))


@query("SELECT l_partkey, l_suppkey, round(avg(l_quantity), 6) + 0.0 AS mean, count(*) - 1 AS collapsed FROM lineitem GROUP BY ALL")
def a14_collapse_duplicates(t: Tables) -> DataFrame:
    return mo.collapsed(t("lineitem"), ["l_partkey", "l_suppkey"], "l_quantity").select("l_partkey", "l_suppkey", r("mean").alias("mean"), "collapsed")


@query(f"WITH {EXPR}, s AS (SELECT state, gene, sum(v) AS s FROM expr GROUP BY ALL) SELECT state, count(*) AS n_positive, min(gene) AS first_gene FROM s WHERE s > 2.2 GROUP BY 1")
def a15_positive_columns(t: Tables) -> DataFrame:
    sums = t.expr().groupBy("state", "gene").agg(F.sum("v").alias("s")).where("s > 2.2")
    return sums.groupBy("state").agg(F.count("*").alias("n_positive"), F.min("gene").alias("first_gene"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) + 0.0 AS total, round(avg(l_quantity), 6) + 0.0 AS mean, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
def a16_a17_a31_grouped_metrics(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("total"), r(F.avg("l_quantity")).alias("mean"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT event_type, round(avg(m), 6) + 0.0 AS mean, count(*) AS n_inner FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY 1")
def a18_mean_of_means(t: Tables) -> DataFrame:
    return mo.mean_of_means(t("events"), ["event_type", "user_id"], ["event_type"], "value").select("event_type", r("mean").alias("mean"), "n_inner")


@query("WITH q AS (SELECT event_type, user_id % 7 AS seed, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, seed, n, round(sd, 6) + 0.0 AS sd, CASE WHEN sd >= 10 THEN 0 WHEN sd >= 1 THEN 1 WHEN sd >= 0.1 THEN 2 ELSE 3 END AS digits, round(CASE WHEN sd >= 10 THEN round(mean, 0) WHEN sd >= 1 THEN round(mean, 1) WHEN sd >= 0.1 THEN round(mean, 2) ELSE round(mean, 3) END, 3) + 0.0 AS shown FROM q")
def a24_seed_summary(t: Tables) -> DataFrame:
    rows = mo.seed_summary(t("events").withColumn("seed", F.col("user_id") % 7), ["event_type", "seed"], "value")
    return rows.select("event_type", "seed", "n", r("sd").alias("sd"), "digits", r("shown", 3).alias("shown"))


@query("SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct, (SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS most FROM lineitem")
def a25_duplicates(t: Tables) -> DataFrame:
    keys = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    return keys.agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.max("c").alias("most"))


@query(f"WITH {EXPR} SELECT a.state, a.gene AS gene_a, b.gene AS gene_b, round(corr(a.v, b.v), 6) + 0.0 AS corr, round(covar_pop(a.v, b.v), 8) + 0.0 AS cov, round(avg(sqrt(abs(a.v - b.v))), 6) + 0.0 AS root_gap FROM expr a JOIN expr b ON a.cell = b.cell AND a.gene < b.gene WHERE a.gene IN (1, 2, 3, 4) AND b.gene IN (1, 2, 3, 4) GROUP BY ALL")
def a26_q20_pair_moments(t: Tables) -> DataFrame:
    rows = mo.pair_correlation(t.expr(), [1, 2, 3, 4], ["state"])
    return rows.select("state", F.col("gene_a").cast("long").alias("gene_a"), F.col("gene_b").cast("long").alias("gene_b"), r("corr").alias("corr"), r("cov", 8).alias("cov"), r("root_gap").alias("root_gap"))


@query(f"WITH {POINTS} SELECT state, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 8) + 0.0 AS rms FROM points GROUP BY 1")
def a28_rms_radius(t: Tables) -> DataFrame:
    return trends.rms_radius(t.points(), ["state"]).select("state", r("rms", 8).alias("rms"))


_SHIFT = f"WITH {EXPR}, m AS (SELECT state, gene, avg(v) FILTER (stage = 0) AS m0, avg(v) FILTER (stage = 1) AS m1 FROM expr GROUP BY ALL), g AS (SELECT gene, avg(v) FILTER (stage = 0) AS g0, avg(v) FILTER (stage = 1) AS g1 FROM expr GROUP BY 1)"


@query(_SHIFT + " SELECT state, gene, round(avg(greatest(v + 0.5 * (0.7 * coalesce(m1 - m0, g1 - g0) + 0.3 * (g1 - g0)), 0)), 8) + 0.0 AS mean FROM expr JOIN m USING (state, gene) JOIN g USING (gene) WHERE stage = 1 GROUP BY ALL")
def x1_x3_damped_stage_shift(t: Tables) -> DataFrame:
    return mo.pseudobulk(trends.damped_shift(t.expr(), damp=0.5, weight=0.7), ["state"]).select("state", "gene", r("mean", 8).alias("mean"))


@query(_SHIFT + " SELECT gene, round(avg(greatest(v + coalesce(m1 - m0, 0), 0)), 8) + 0.0 AS mean, count(*) AS n FROM expr JOIN m USING (state, gene) JOIN g USING (gene) WHERE stage = 1 GROUP BY 1")
def x2_stage_shift(t: Tables) -> DataFrame:
    shifted = trends.stage_shift(t.expr())
    return shifted.groupBy("gene").agg(r(F.avg("v"), 8).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {EXPR}, d AS (SELECT state, gene, quantile_cont(v, 0.5) FILTER (stage = 1) - quantile_cont(v, 0.5) FILTER (stage = 0) AS d FROM expr GROUP BY ALL) SELECT state, gene, round(avg(greatest(v + 0.5 * 1.5 * d, 0)), 6) + 0.0 AS mean FROM expr JOIN d USING (state, gene) WHERE stage = 1 AND d IS NOT NULL GROUP BY ALL")
def x5_median_extrapolation(t: Tables) -> DataFrame:
    return mo.pseudobulk(trends.median_extrapolated(t.expr(), damp=0.5, factor=1.5), ["state"]).select("state", "gene", r("mean").alias("mean"))


@query("SELECT event_type, round(regr_slope(value, event_id % 30), 8) + 0.0 AS slope, round(regr_slope(value, event_id % 30) * 31 + regr_intercept(value, event_id % 30), 6) + 0.0 AS at FROM events GROUP BY 1")
def x6_linear_trend(t: Tables) -> DataFrame:
    rows = mo.trend_at(t("events").withColumn("x", (F.col("event_id") % 30).cast("double")), ["event_type"], "x", "value", 31.0)
    return rows.select("event_type", r("slope", 8).alias("slope"), r("at").alias("at"))


@query(f"WITH {EXPR}, m AS (SELECT gene, avg(v) FILTER (cell % 3 = 0) AS a, avg(v) FILTER (cell % 3 = 1) AS b, avg(v) FILTER (cell % 3 = 2) AS c FROM expr GROUP BY 1) SELECT gene, round(a * ((3.5 - 1) * (3.5 - 2)) / 2 - b * (3.5 * (3.5 - 2)) + c * (3.5 * (3.5 - 1)) / 2, 6) + 0.0 AS at FROM m")
def x7_x12_parabola(t: Tables) -> DataFrame:
    m = t.expr().groupBy("gene").agg(*(F.avg(F.when(F.col("cell") % 3 == k, F.col("v"))).alias(f"m{k}") for k in range(3)))
    return m.select("gene", r(mo.lagrange([F.col("m0"), F.col("m1"), F.col("m2")], [0.0, 1.0, 2.0], 3.5)).alias("at"))


@query("WITH c AS (SELECT event_type, event_id % 3 AS k, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, k, n / sum(n) OVER (PARTITION BY k) AS p FROM c), f AS (SELECT event_type, regr_slope(ln(p), k) * 3 + regr_intercept(ln(p), k) AS l, max(p) FILTER (k = 2) AS ref FROM s GROUP BY 1), b AS (SELECT event_type, least(greatest(exp(l), ref / 1.05), ref * 1.05) AS x FROM f) SELECT event_type, round(x / sum(x) OVER (), 8) + 0.0 AS share FROM b")
def x8_log_share_trend(t: Tables) -> DataFrame:
    rows = t("events").withColumn("k", F.col("event_id") % 3)
    return trends.log_share_trend(rows, "event_type", "k", at=3.0, last=2, fold=1.05).select("event_type", r("share", 8).alias("share"))


@query("WITH c AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) / (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS p0, count(*) FILTER (event_id % 2 = 1) / (SELECT count(*) FROM events WHERE event_id % 2 = 1) AS p1 FROM events GROUP BY 1), x AS (SELECT event_type, CASE WHEN p0 = 0 THEN p1 ELSE greatest(0.01, 2 * p1 - p0) END AS x FROM c) SELECT event_type, round(x / sum(x) OVER (), 8) + 0.0 AS share FROM x")
def x9_composition_extrapolation(t: Tables) -> DataFrame:
    before, after = _halves(t)
    return trends.extrapolated_shares(before, after, "event_type", floor=0.01).select("event_type", r("share", 8).alias("share"))


@query(f"WITH {EXPR}, d AS (SELECT state, gene, sum((v - g0) * (v - g0)) AS q FROM expr JOIN (SELECT gene, avg(v) AS g0 FROM expr GROUP BY 1) USING (gene) GROUP BY ALL), m AS (SELECT state, avg(v) AS m FROM expr WHERE gene = 5 GROUP BY 1) SELECT state, round(least(greatest(m / max(m) OVER (), 0), 1), 8) + 0.0 AS gate FROM m")
def x14_state_gates(t: Tables) -> DataFrame:
    return trends.state_gates(t.expr(), 5).select("state", r("gate", 8).alias("gate"))
