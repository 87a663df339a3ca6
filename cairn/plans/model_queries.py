"""Queries of sources, models (2.12) and further operators (2.15)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import fits, geometry, matrix, models, ranks, trends
from cairn.operators import moments as mo
from cairn.operators.lineage import settled
from cairn.sources import readers

from .registry import EXPR, POINTS, Tables, query, r


@query("SELECT p_type AS gene, CAST(row_number() OVER (ORDER BY min(p_partkey)) AS BIGINT) AS gene_pos, count(*) AS occurs FROM part GROUP BY 1")
def s4_panel(t: Tables) -> DataFrame:
    lines = t("part").select(F.concat(F.lit(" "), "p_type").alias("value"), F.col("p_partkey").alias("line"))
    rows = readers.panel(lines)
    first = rows.groupBy("gene").agg(F.min("gene_pos").alias("p"), F.max("occurs").alias("occurs"))
    return ranks.row_numbers(first, ["p"], "gene_pos").select("gene", (F.col("gene_pos") + 1).alias("gene_pos"), "occurs")


_MM = "mm AS (SELECT l_orderkey % 500 + 1 AS row, l_partkey % 90 + 1 AS col, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _mm(t: Tables) -> DataFrame:
    e = t("lineitem").groupBy((F.col("l_orderkey") % 500 + 1).alias("row"), (F.col("l_partkey") % 90 + 1).alias("col")).agg(F.sum("l_quantity").alias("v"))
    lines = e.select(F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("v").cast("string")).alias("value"))
    return lines.unionByName(t.spark.sql("SELECT * FROM VALUES ('%%MatrixMarket matrix coordinate'), ('% made of rows') AS c(value)"))


@query(f"WITH {_MM} SELECT col, count(*) AS n, round(sum(v), 4) + 0.0 AS total FROM mm WHERE col < (SELECT max(col) FROM mm) GROUP BY 1")
def s7_s8_truncated_matrix(t: Tables) -> DataFrame:
    return readers.matrix_market(_mm(t), nnz=10**9).groupBy("col").agg(F.count("*").alias("n"), r(F.sum("v"), 4).alias("total"))


@query(f"WITH {_MM}, k AS (SELECT col, row_number() OVER (ORDER BY col) AS new FROM (SELECT DISTINCT col FROM mm WHERE col % 7 = 2)) SELECT new AS col, count(*) AS n, round(sum(v), 4) + 0.0 AS total FROM mm JOIN k USING (col) GROUP BY 1")
def s9_s10_matrix_columns(t: Tables) -> DataFrame:
    e = readers.matrix_market(_mm(t))
    return readers.column_filtered(e, e.where("col % 7 = 2").select("col")).groupBy("col").agg(F.count("*").alias("n"), r(F.sum("v"), 4).alias("total"))


@query(f"WITH {_MM} SELECT CAST(count(*) FILTER (row > 400 OR col > 80) AS BIGINT) AS out_of_bounds, count(*) FILTER (v < 0) AS negative, CAST(0 AS BIGINT) AS repeated FROM mm")
def s11_matrix_bounds(t: Tables) -> DataFrame:
    return readers.in_bounds(readers.matrix_market(_mm(t)), 400, 80)


@query("WITH l AS (SELECT c_nationkey AS f, c_custkey AS line, CASE WHEN c_custkey % 5 = 0 THEN '^SAMPLE = C' || c_custkey ELSE c_name END AS v FROM customer), b AS (SELECT *, last_value(CASE WHEN v LIKE '^SAMPLE =%' THEN substr(v, 11) END IGNORE NULLS) OVER (PARTITION BY f ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM l) SELECT block, count(*) AS n, min(v) AS first_line FROM b WHERE v NOT LIKE '^SAMPLE =%' AND block IS NOT NULL GROUP BY 1")
def s12_s15_blocks(t: Tables) -> DataFrame:
    value = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("^SAMPLE = C"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    lines = t("customer").select(F.col("c_nationkey").alias("f"), F.col("c_custkey").alias("line"), value.alias("value"))
    return readers.blocks(lines, r"\^SAMPLE", ["f"]).groupBy("block").agg(F.count("*").alias("n"), F.min("value").alias("first_line"))


_FEATURES = "f AS (SELECT 'chr' || p_size % 3 AS chrom, p_partkey * 10 AS s, p_partkey * 10 + p_size AS e, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS gene FROM part)"


@query(f"WITH {_FEATURES} SELECT gene, min(chrom) AS chrom, min(strand) AS strand, CASE WHEN min(strand) = '-' THEN max(e) ELSE min(s) END AS tss FROM f GROUP BY 1")
def s13_start_sites(t: Tables) -> DataFrame:
    p = t("part")
    f = p.select(F.concat(F.lit("chr"), (F.col("p_size") % 3).cast("string")).alias("chrom"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("end"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit('gene_id "x"; gene_name "'), "p_brand", F.lit('";')).alias("attributes"))
    return readers.start_sites(f)


@query("WITH i AS (SELECT 'c' || o_custkey % 4 AS chrom, o_orderkey * 3 AS s, o_orderkey * 3 + 5 AS e, o_totalprice AS v FROM orders), w AS (SELECT 'w' || c_custkey AS name, 'c' || c_custkey % 4 AS chrom, c_custkey * 20 AS ws, c_custkey * 20 + 37 AS we FROM customer), j AS (SELECT name, v, least(e, we) - greatest(s, ws) AS n FROM w JOIN i USING (chrom) WHERE s < we AND ws < e) SELECT name, round(sum(v * n) / sum(n) / 7, 4) + 0.0 AS mean_7, round(max(v), 4) + 0.0 AS top FROM j GROUP BY 1")
def s17_interval_means(t: Tables) -> DataFrame:
    key = lambda c: F.concat(F.lit("c"), (F.col(c) % 4).cast("string")).alias("chrom")
    i = t("orders").select(key("o_custkey"), (F.col("o_orderkey") * 3).alias("start"), (F.col("o_orderkey") * 3 + 5).alias("end"), F.col("o_totalprice").alias("value"))
    w = t("customer").select(F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("name"), key("c_custkey"), (F.col("c_custkey") * 20).alias("start"), (F.col("c_custkey") * 20 + 37).alias("end"))
    return readers.interval_means(i, w, 64).select("name", r(F.col("mean") / 7, 4).alias("mean_7"), r("top", 4).alias("top"))


@query(f"WITH {EXPR}, nm AS (SELECT g AS gene, 'n' || g AS name FROM range(1, 65) r(g)), w AS (SELECT name, row_number() OVER (ORDER BY gene DESC) AS target FROM nm JOIN nm2 USING (gene)) SELECT cell, target AS gene, round(v, 6) + 0.0 AS v FROM expr JOIN nm USING (gene) JOIN w USING (name)".replace("FROM nm JOIN nm2 USING (gene))", "FROM nm WHERE gene % 9 = 0)"))
def s2_s3_panel_alignment(t: Tables) -> DataFrame:
    names = t.spark.range(1, 65).select(F.col("id").alias("gene_pos"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("gene"))
    wanted = names.where("gene_pos % 9 = 0").select("gene", F.row_number().over(Window.orderBy(F.desc("gene_pos"))).cast("long").alias("gene_pos"))
    return readers.aligned(t.expr(), names, wanted).select("cell", "gene", r("v").alias("v"))


@query("WITH e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events WHERE event_type IN ('click', 'view')), q AS (SELECT event_id, event_type = 'view' AS side, (a <= value)::INT + (b <= value)::INT + (c <= value)::INT AS bin FROM events, e WHERE event_type IN ('click', 'view')), k AS (SELECT *, row_number() OVER (PARTITION BY bin, side ORDER BY md5('21:' || event_id), event_id) AS r, least(count(*) FILTER (side) OVER (PARTITION BY bin), count(*) FILTER (NOT side) OVER (PARTITION BY bin)) AS n FROM q) SELECT event_id, bin FROM k WHERE r <= n")
def y1_depth_matched(t: Tables) -> DataFrame:
    rows = t("events").where("event_type in ('click', 'view')").withColumn("side", (F.col("event_type") == "view").cast("int"))
    return models.depth_matched(rows, "side", "value", "event_id", 4, 21).select("event_id", "bin")


@query(f"WITH {EXPR}, d AS (SELECT state, gene, avg(v) FILTER (stage = 1) - avg(v) FILTER (stage = 0) AS d FROM expr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY d DESC, gene) AS u, row_number() OVER (PARTITION BY state ORDER BY d, gene) AS w FROM d) SELECT state, gene, round(CASE WHEN (u <= 5 AND d > 0) OR (w <= 5 AND d < 0) THEN d ELSE 0 END, 8) + 0.0 AS sparse FROM k")
def y2_sparsified_delta(t: Tables) -> DataFrame:
    d = t.expr().groupBy("state", "gene").agg((F.avg(F.when(F.col("stage") == 1, F.col("v"))) - F.avg(F.when(F.col("stage") == 0, F.col("v")))).alias("d"))
    return models.sparsified(d, ["state"], "d", 5, "gene").select("state", "gene", r("sparse", 8).alias("sparse"))


@query(f"WITH {EXPR}, s AS (SELECT state, gene, avg(v) FILTER (stage = 0) AS m0, avg(v) FILTER (stage = 1) AS m1, var_pop(v) FILTER (stage = 0) AS v0, var_pop(v) FILTER (stage = 1) AS v1, count(*) FILTER (stage = 0) AS n0, count(*) FILTER (stage = 1) AS n1 FROM expr GROUP BY ALL), d AS (SELECT *, m1 - m0 AS d, sqrt(v0 / n0 + v1 / n1) AS se FROM s) SELECT state, gene, round(d * CASE WHEN se > 0 THEN abs(d / se) / (abs(d / se) + 2) ELSE 0 END, 8) + 0.0 AS delta FROM d")
def y4_shrunk_delta(t: Tables) -> DataFrame:
    on = lambda s, f: f(F.when(F.col("stage") == s, F.col("v")))
    g = t.expr().groupBy("state", "gene").agg(*(on(s, f).alias(f"{n}{s}") for s in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))))
    d = F.col("m1") - F.col("m0")
    se = matrix.standard_error(F.col("v0"), F.col("n0"), F.col("v1"), F.col("n1"))
    return g.select("state", "gene", r(d * matrix.shrink_weight(d, se, 2.0), 8).alias("delta"))


@query(f"WITH {POINTS}, g AS (SELECT avg(x) FILTER (stage = 1) AS mx, avg(y) FILTER (stage = 1) AS my, avg(z) FILTER (stage = 1) AS mz, sqrt(var_pop(x) FILTER (stage = 0) + var_pop(y) FILTER (stage = 0) + var_pop(z) FILTER (stage = 0)) AS r0, sqrt(var_pop(x) FILTER (stage = 1) + var_pop(y) FILTER (stage = 1) + var_pop(z) FILTER (stage = 1)) AS r1 FROM points) SELECT cell, round(mx + (x - mx) * (r1 + 0.5 * (r1 - r0)) / r1, 6) + 0.0 AS x, round(my + (y - my) * (r1 + 0.5 * (r1 - r0)) / r1, 6) + 0.0 AS y, round(mz + (z - mz) * (r1 + 0.5 * (r1 - r0)) / r1, 6) + 0.0 AS z FROM points, g WHERE stage = 1")
def y5_g7_scale_shift(t: Tables) -> DataFrame:
    p = t.points()
    stage = trends.rms_radius(p, ["stage"])
    r0, r1 = (F.max(F.when(F.col("stage") == s, F.col("rms"))) for s in (0, 1))
    factor = stage.agg(((r1 + 0.5 * (r1 - r0)) / r1).alias("f"))
    mean = p.where("stage = 1").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    rows = p.where("stage = 1").crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(factor))
    return rows.select("cell", *(r(F.col(f"m{c}") + (F.col(c) - F.col(f"m{c}")) * F.col("f")).alias(c) for c in "xyz"))


@query(f"WITH {EXPR}, j AS (SELECT a.state, b.gene, a.v AS x, b.v AS y FROM expr a JOIN expr b USING (cell) WHERE a.gene = 1 AND b.gene > 1), m AS (SELECT state, gene, avg(x) AS mx, avg(y) AS my FROM j GROUP BY ALL HAVING count(*) >= 20), s AS (SELECT gene, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (x - mx)) AS xx FROM j JOIN m USING (state, gene) GROUP BY 1) SELECT gene, round(CASE WHEN xx > 1e-12 THEN xy / xx ELSE 0 END, 6) + 0.0 AS slope FROM s".replace("SELECT a.state, b.gene", "SELECT a.state AS state, b.gene AS gene"))
def y9_demeaned_slope(t: Tables) -> DataFrame:
    e = t.expr()
    j = e.where("gene > 1").join(e.where("gene = 1").select("cell", F.col("v").alias("x")), "cell")
    return models.demeaned_slope(j, "state", "x", "v", 20, ["gene"]).select("gene", r("slope").alias("slope"))


@query("SELECT event_id, CAST(sign(value - 50) AS INTEGER) AS sign, round(row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50), event_id) / (count(*) OVER (PARTITION BY event_type) + 1), 8) + 0.0 AS confidence FROM events")
def y10_y11_signed_confidence(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type")
    e = F.col("value") - 50
    k = F.row_number().over(w.orderBy(F.abs(e), "event_id")) / (F.count("*").over(w) + 1)
    return t("events").select("event_id", F.signum(e).cast("int").alias("sign"), r(k, 8).alias("confidence"))


@query("WITH g AS (SELECT source, lang, count(*) AS support, count(DISTINCT doc_id % 5) AS families, round(avg((n_chars % 100) / 100.0), 6) + 0.0 AS confidence FROM documents GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, support DESC, lang) AS place FROM g")
def y12_program_aggregation(t: Tables) -> DataFrame:
    g = t("documents").groupBy("source", "lang").agg(F.count("*").alias("support"), F.count_distinct(F.col("doc_id") % 5).alias("families"), r(F.avg(F.col("n_chars") % 100 / 100)).alias("confidence"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), F.desc("support"), "lang"))
    return g.withColumn("place", place.cast("long"))


@query(f"WITH {EXPR}, g AS (SELECT state, avg(v) AS m FROM expr WHERE gene = 5 GROUP BY 1), w AS (SELECT state, least(greatest(m / max(m) OVER (), 0), 1) AS gate FROM g) SELECT state, gene, round(avg(CASE WHEN gene = 5 THEN 0 ELSE greatest(v + gate * CASE WHEN gene % 2 = 0 THEN 0.05 ELSE -0.05 END, 0) END), 8) + 0.0 AS mean FROM expr JOIN w USING (state) GROUP BY ALL")
def y13_x13_program_application(t: Tables) -> DataFrame:
    entries = t.expr()
    rows = entries.join(trends.state_gates(entries, 5), "state")
    step = F.when(F.col("gene") % 2 == 0, 0.05).otherwise(-0.05)
    v = F.when(F.col("gene") == 5, 0.0).otherwise(F.greatest(F.col("v") + F.col("gate") * step, F.lit(0.0)))
    return rows.groupBy("state", "gene").agg(r(F.avg(v), 8).alias("mean"))


@query(f"WITH RECURSIVE {EXPR}, g AS (SELECT gene, list(exp(v) - 1) FILTER (stage = 0) AS c, avg(v) FILTER (stage = 1) AS t FROM expr GROUP BY 1), h AS (SELECT gene, 0 AS k, -2.0::DOUBLE AS lo, 2.0::DOUBLE AS hi FROM g UNION ALL SELECT gene, k + 1, CASE WHEN m < t THEN mid ELSE lo END, CASE WHEN m < t THEN hi ELSE mid END FROM (SELECT h.gene, k, lo, hi, (lo + hi) / 2 AS mid, t, list_avg(list_transform(c, lambda x: ln(1 + x * exp((lo + hi) / 2)))) AS m FROM h JOIN g ON g.gene = h.gene WHERE k < 36)) SELECT gene, round((lo + hi) / 2, 6) + 0.0 AS rate FROM h WHERE k = 36")
def y15_y16_calibrated_rates(t: Tables) -> DataFrame:
    e = t.expr().where("stage = 0")
    target = t.expr().where("stage = 1").groupBy("gene").agg(F.avg("v").alias("target"))
    return fits.calibrated_rates(e.join(target, "gene"), ["gene"], "v", "target", 2.0).select("gene", r("rate").alias("rate"))


@query(f"WITH {EXPR}, m AS (SELECT state, gene, avg(v) FILTER (stage = 0) AS a, avg(v) FILTER (stage = 1) AS b FROM expr GROUP BY ALL) SELECT state, gene, round(least(greatest(ln(greatest(exp(b) - 1, 1e-3) / greatest(exp(a) - 1, 1e-3)), -1), 1), 6) + 0.0 AS ratio FROM m")
def y17_mean_ratio(t: Tables) -> DataFrame:
    m = t.expr().groupBy("state", "gene").agg(*(F.avg(F.when(F.col("stage") == s, F.col("v"))).alias(n) for s, n in ((0, "a"), (1, "b"))))
    floor = lambda c: F.greatest(F.expm1(c), F.lit(1e-3))
    return m.select("state", "gene", r(F.least(F.greatest(F.log(floor("b") / floor("a")), F.lit(-1.0)), F.lit(1.0))).alias("ratio"))


@query("WITH d AS (SELECT event_type, user_id % 30 AS g, value / 100 AS x, (value + event_id % 7) / 100 AS y, event_id % 4 <> 0 AND event_type <> 'view' AS train FROM events), o AS (SELECT event_type, avg(y) AS m, sum(x * y) / (sum(x * x) + 10) AS s FROM d WHERE train GROUP BY 1), p AS (SELECT avg(y) AS m, sum(x * y) / (sum(x * x) + 10) AS s FROM d WHERE train) SELECT t.event_type, round(coalesce(o.m, p.m), 8) + 0.0 AS mean, round(least(greatest(coalesce(o.s, p.s), 0), 1), 8) + 0.0 AS slope FROM (SELECT DISTINCT event_type FROM d) t LEFT JOIN o USING (event_type), p")
def y18_residual_calibration(t: Tables) -> DataFrame:
    d = t("events").select("event_type", (F.col("value") / 100).alias("x"), ((F.col("value") + F.col("event_id") % 7) / 100).alias("y"), ((F.col("event_id") % 4 != 0) & (F.col("event_type") != "view")).alias("train"))
    return models.residual_calibration(d, "event_type", "x", "y", 10.0, "train").select("event_type", r("mean", 8).alias("mean"), r("slope", 8).alias("slope"))


@query("WITH p AS (SELECT event_type, event_id % 6 AS part, avg(value) - 50 AS m FROM events GROUP BY ALL), s AS (SELECT event_type, avg(m) AS mu, stddev_pop(m) AS sd, abs(avg(sign(m))) AS agree, greatest(avg(abs(m)), 1e-8) AS size FROM p GROUP BY 1) SELECT event_type, round(agree * abs(mu) / (abs(mu) + sd + 0.5 * size), 6) + 0.0 AS weight FROM s")
def y19_stability_weight(t: Tables) -> DataFrame:
    p = t("events").groupBy("event_type", (F.col("event_id") % 6).alias("part")).agg((F.avg("value") - 50).alias("m"))
    s = p.groupBy("event_type").agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"), F.abs(F.avg(F.signum("m"))).alias("agree"), F.greatest(F.avg(F.abs("m")), F.lit(1e-8)).alias("size"))
    return s.select("event_type", r(F.col("agree") * F.abs("mu") / (F.abs("mu") + F.col("sd") + 0.5 * F.col("size"))).alias("weight"))


@query(f"WITH {EXPR}, m AS (SELECT state, gene, abs(avg(v) FILTER (stage = 1) - avg(v) FILTER (stage = 0)) AS d FROM expr GROUP BY ALL) SELECT state, gene, round(d / sqrt(sum(d * d) OVER (PARTITION BY state)), 6) + 0.0 AS shape FROM m")
def y20_unsigned_shape(t: Tables) -> DataFrame:
    m = t.expr().groupBy("state", "gene").agg(F.abs(F.avg(F.when(F.col("stage") == 1, F.col("v"))) - F.avg(F.when(F.col("stage") == 0, F.col("v")))).alias("d"))
    norm = m.groupBy("state").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("n"))
    return m.join(norm, "state").select("state", "gene", r(F.col("d") / F.col("n")).alias("shape"))


@query(f"WITH {EXPR}, m AS (SELECT state, gene, avg(v) FILTER (stage = 1) - avg(v) FILTER (stage = 0) AS d, least(count(*) FILTER (stage = 0), count(*) FILTER (stage = 1)) AS n FROM expr GROUP BY ALL) SELECT state, gene, round(CASE WHEN gene IN (1, 2) OR n < 20 THEN 0 ELSE d * n / (n + 50.0) END, 8) + 0.0 AS delta FROM m")
def y21_anchor_delta(t: Tables) -> DataFrame:
    on = lambda s, f: f(F.when(F.col("stage") == s, F.col("v")))
    m = t.expr().groupBy("state", "gene").agg((on(1, F.avg) - on(0, F.avg)).alias("d"), F.least(on(0, F.count), on(1, F.count)).alias("n"))
    return m.select("state", "gene", r(F.when(F.col("gene").isin(1, 2) | (F.col("n") < 20), 0.0).otherwise(F.col("d") * F.col("n") / (F.col("n") + 50)), 8).alias("delta"))


@query("WITH s AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) / (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS p, count(*) FILTER (event_id % 2 = 1) / (SELECT count(*) FROM events WHERE event_id % 2 = 1) AS q FROM events GROUP BY 1), x AS (SELECT event_type, p * exp(0.4 * ln(q / p)) AS x FROM s) SELECT event_type, round(x / sum(x) OVER (), 8) + 0.0 AS tempered FROM x")
def y22_tempered_weights(t: Tables) -> DataFrame:
    s = mo.shares(t("events").withColumn("k", F.col("event_id") % 2), ["event_type"], ["k"])
    both = s.groupBy("event_type").agg(*(F.max(F.when(F.col("k") == k, F.col("share"))).alias(n) for k, n in ((0, "p"), (1, "q"))))
    return models.tempered(both, "p", "q", 0.4).select("event_type", r("tempered", 8).alias("tempered"))


@query(f"WITH {EXPR}, k AS (SELECT cell, gene, (rank() OVER (PARTITION BY cell ORDER BY v) + (count(*) OVER (PARTITION BY cell, v) - 1) / 2.0) / 64 - 65.0 / 128 AS r FROM expr), w AS (SELECT g AS gene, CASE WHEN g <= 8 THEN 'a' ELSE 'b' END AS program, CASE WHEN g % 3 = 0 THEN -1.0 ELSE 0.5 END AS weight FROM range(1, 17) x(g)) SELECT cell, program, round(sum(r * weight) / sum(abs(weight)), 12) + 0.0 AS score FROM k JOIN w USING (gene) GROUP BY ALL")
def y24_program_scores(t: Tables) -> DataFrame:
    g = F.col("id")
    w = t.spark.range(1, 17).select(g.alias("gene"), F.when(g <= 8, "a").otherwise("b").alias("program"), F.when(g % 3 == 0, -1.0).otherwise(0.5).alias("weight"))
    return models.program_scores(t.expr(), w).select("cell", "program", r("score", 12).alias("score"))


@query(f"WITH {EXPR}, m AS (SELECT state, quantile_cont(v, 0.5) FILTER (v > 0) AS m FROM expr WHERE gene = 9 GROUP BY 1), f AS (SELECT quantile_cont(m, 0.5) AS f FROM m) SELECT cell, round(least(greatest(v / coalesce(m, f), 0), 1), 6) + 0.0 AS gate FROM expr JOIN m USING (state), f WHERE gene = 9")
def y26_activity_gate(t: Tables) -> DataFrame:
    e = t.expr().where("gene = 9")
    m = e.groupBy("state").agg(F.percentile(F.when(F.col("v") > 0, F.col("v")), F.lit(0.5)).alias("m"))
    rows = e.join(m, "state").crossJoin(F.broadcast(m.agg(F.percentile("m", F.lit(0.5)).alias("f"))))
    return rows.select("cell", r(F.least(F.greatest(F.col("v") / F.coalesce("m", "f"), F.lit(0.0)), F.lit(1.0))).alias("gate"))


@query(f"WITH {EXPR} SELECT cell, 'm' || (gene - 1) // 16 AS module, round(avg(v), 8) + 0.0 AS score FROM expr GROUP BY ALL")
def y29_module_scores(t: Tables) -> DataFrame:
    module = F.concat(F.lit("m"), F.floor((F.col("gene") - 1) / 16).cast("string"))
    return t.expr().groupBy("cell", module.alias("module")).agg(r(F.avg("v"), 8).alias("score"))


@query(f"WITH {EXPR}, m AS (SELECT gene, avg(v) AS m FROM expr WHERE stage = 0 GROUP BY 1), t AS (SELECT gene, avg(v) AS t FROM expr WHERE stage = 1 GROUP BY 1), s AS (SELECT gene, avg(greatest(v + t - m, 0)) AS reached, max(t) AS t FROM expr JOIN m USING (gene) JOIN t USING (gene) WHERE stage = 0 GROUP BY 1) SELECT gene, round(reached, 8) + 0.0 AS reached, round(reached - t, 8) + 0.0 AS gap FROM s")
def y32_mean_shift(t: Tables) -> DataFrame:
    e = t.expr()
    m = e.groupBy("gene").agg(*(F.avg(F.when(F.col("stage") == s, F.col("v"))).alias(n) for s, n in ((0, "m"), (1, "t"))))
    reached = F.avg(F.greatest(F.col("v") + F.col("t") - F.col("m"), F.lit(0.0)))
    return e.where("stage = 0").join(m, "gene").groupBy("gene").agg(r(reached, 8).alias("reached"), r(reached - F.max("t"), 8).alias("gap"))


@query("WITH s AS (SELECT event_type, event_id % 4 AS stage, avg(value) AS m FROM events GROUP BY ALL), w AS (SELECT *, CASE stage WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 2.0 END AS w FROM s) SELECT event_type, round(sum(w * m) / sum(w), 6) + 0.0 AS mean FROM w WHERE w > 0 GROUP BY 1")
def y33_weighted_stage_mean(t: Tables) -> DataFrame:
    s = t("events").groupBy("event_type", (F.col("event_id") % 4).alias("stage")).agg(F.avg("value").alias("m"))
    w = F.when(F.col("stage") == 0, 1.0).when(F.col("stage") == 1, 0.0).when(F.col("stage") == 2, 2.0)
    return s.withColumn("w", w).where("w > 0").groupBy("event_type").agg(r(F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("mean"))


@query()
def l1_kernel_ridge(t: Tables) -> DataFrame:
    """Changes of the odd genes over states, foretold from their profiles by the even genes: all of these are landmarks."""
    on = lambda s: F.coalesce(F.avg(F.when(F.col("stage") == s, F.col("v"))), F.lit(0.0))
    m = t.expr().groupBy("gene", "state").agg(on(0).alias("a"), on(1).alias("b"))
    rows = m.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("state", "a", "b"))).alias("s"))  # a gene's states
    rows = settled(rows.select(F.col("gene").alias("id"), F.col("s.a").alias("x"), F.transform("s", lambda v: v["b"] - v["a"]).alias("y"), F.col("s.state").alias("states")))
    out = fits.kernel_predictor(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 0.1)
    long = out.join(rows.select("id", "states"), "id").select("id", F.posexplode("prediction").alias("i", "delta"), "states")
    return long.select(F.col("id").alias("gene"), F.get("states", F.col("i")).alias("state"), r("delta", 6).alias("delta"))


@query()
def l3_state_atlas(t: Tables) -> DataFrame:
    """Principal components and k-means of all cells, by the distributed library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    x = t.cells().select("cell", array_to_vector("x").alias("x"))
    z = PCA(k=8, inputCol="x", outputCol="z").fit(x).transform(x)
    return KMeans(k=6, seed=1, featuresCol="z", predictionCol="cluster").fit(z).transform(z).select("cell", "cluster")


@query()
def a27_y30_l6_shrunk_precision(t: Tables) -> DataFrame:
    """Regressors of each gene on the others, -P / diag(P), from a covariance shrunk as far as its own noise tells."""
    c, shrinkage = models.estimated_covariance(t.cells(), "x", 64)
    c = models.to_correlation(geometry.spd_projection(models.shrunk_covariance(c, shrinkage), 1e-6))
    p = np.linalg.inv(c)
    b = -p / np.diag(p)[:, None]
    return t.spark.createDataFrame([(a + 1, g + 1, float(round(b[a, g], 8))) for a in range(64) for g in range(64) if a != g], "gene int, on_gene int, weight double")


@query(f"WITH {EXPR}, s AS (SELECT gene, sum((avg_t - avg_m) * d) AS sd, sum(d * d) AS dd FROM (SELECT state, gene, avg(v) FILTER (cell % 3 = 1) AS avg_t, avg(v) FILTER (cell % 3 = 0) AS avg_m, avg(v) FILTER (cell % 3 = 2) - avg(v) FILTER (cell % 3 = 0) AS d FROM expr GROUP BY ALL) GROUP BY 1) SELECT gene, round(least(greatest(sd / dd, 0), 1), 6) + 0.0 AS weight FROM s WHERE dd > 0")
def l7_gene_shrinkage(t: Tables) -> DataFrame:
    on = lambda k: F.avg(F.when(F.col("cell") % 3 == k, F.col("v")))
    m = t.expr().groupBy("state", "gene").agg((on(1) - on(0)).alias("t"), (on(2) - on(0)).alias("d"))
    g = m.groupBy("gene").agg(F.sum(F.col("t") * F.col("d")).alias("sd"), F.sum(F.col("d") * F.col("d")).alias("dd")).where("dd > 0")
    return g.select("gene", r(F.least(F.greatest(F.col("sd") / F.col("dd"), F.lit(0.0)), F.lit(1.0))).alias("weight"))


@query(f"WITH {EXPR}, s AS (SELECT gene, stage, avg((v > 0)::INT) AS p, quantile_cont(v, 0.5) FILTER (v > 0) AS q FROM expr GROUP BY ALL), j AS (SELECT a.gene, a.p AS p0, b.p AS p1, a.q AS q0, b.q AS q1 FROM s a JOIN s b ON a.gene = b.gene AND a.stage = 0 AND b.stage = 1), k AS (SELECT *, least(greatest(ln((p1 + 1e-3) / (1 - p1 + 1e-3)) - ln((p0 + 1e-3) / (1 - p0 + 1e-3)), -2), 2) AS l FROM j) SELECT gene, round(l, 6) + 0.0 AS logit_step, round(least(greatest(ln(q1 / q0), -ln(2)), ln(2)), 6) + 0.0 AS log_step FROM k")
def w13_l13_hurdle_fit(t: Tables) -> DataFrame:
    on = lambda s: F.col("stage") == s
    p = lambda s: F.avg(F.when(on(s), (F.col("v") > 0).cast("double"))).alias(f"p{s}")
    q = lambda s: F.percentile(F.when(on(s) & (F.col("v") > 0), F.col("v")), F.lit(0.5)).alias(f"q{s}")
    g = t.expr().groupBy("gene").agg(p(0), p(1), q(0), q(1))
    logit = lambda c: F.log((F.col(c) + 1e-3) / (1 - F.col(c) + 1e-3))
    two = F.log(F.lit(2.0))
    return g.select("gene", r(F.least(F.greatest(logit("p1") - logit("p0"), F.lit(-2.0)), F.lit(2.0))).alias("logit_step"), r(F.least(F.greatest(F.log(F.col("q1") / F.col("q0")), -two), two)).alias("log_step"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a32_grouping_sets(t: Tables) -> DataFrame:
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"WITH {EXPR}, k AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene) AS n FROM expr), u AS (SELECT cell, gene, (r - 0.5) / n AS u FROM k) SELECT cell, gene, round(CASE WHEN u < 0.5 THEN -(sqrt(-2 * ln(u)) - (2.515517 + 0.802853 * sqrt(-2 * ln(u)) - 0.010328 * 2 * ln(u)) / (1 + 1.432788 * sqrt(-2 * ln(u)) - 0.189269 * 2 * ln(u) + 0.001308 * pow(sqrt(-2 * ln(u)), 3))) ELSE sqrt(-2 * ln(1 - u)) - (2.515517 + 0.802853 * sqrt(-2 * ln(1 - u)) - 0.010328 * 2 * ln(1 - u)) / (1 + 1.432788 * sqrt(-2 * ln(1 - u)) - 0.189269 * 2 * ln(1 - u) + 0.001308 * pow(sqrt(-2 * ln(1 - u)), 3)) END, 6) + 0.0 AS z FROM u")
def w5_gaussian_rank(t: Tables) -> DataFrame:
    u = ranks.normalised_rank("v", ["gene"])
    return t.expr().withColumn("u", u).select("cell", "gene", r(ranks.normal_quantile(F.col("u"))).alias("z"))


@query("WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS parent_row FROM customer), o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS out_row FROM orders) SELECT out_row, parent_row, o_orderkey AS out_name, o_custkey AS parent_name FROM o LEFT JOIN p ON c_custkey = o_custkey")
def k4_row_provenance(t: Tables) -> DataFrame:
    """Which customer, by place, each order comes from, orders in the order of their price."""
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("parent"), (-F.col("o_totalprice")).alias("price"))
    parents = t("customer").select(F.col("c_custkey").alias("parent"))
    return readers.provenance(orders, parents, "o_orderkey", "parent", ["price", "o_orderkey"], ["parent"])
