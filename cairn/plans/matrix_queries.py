"""Queries of projection and scalar operators and of filters (2.3)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import filters, matrix
from cairn.operators import moments as mo

from .registry import CELLS, EXPR, Tables, query, r


def _long(t: Tables, x, name: str = "value") -> DataFrame:
    """Entries of a transformed array, rounded."""
    cells = t.cells().withColumn("x", x)
    return matrix.to_long(cells).select("cell", "gene", r("v").alias(name))


@query(f"WITH {EXPR}, s AS (SELECT cell, sum(v) AS m FROM expr GROUP BY cell) SELECT cell, gene, round(ln(1 + v * 1e4 / m), 6) + 0.0 AS value FROM expr JOIN s USING (cell) WHERE m > 0")
def p1_log_cp10k(t: Tables) -> DataFrame:
    return _long(t, matrix.log_cp10k(F.col("x")))


@query(f"WITH {EXPR}, s AS (SELECT cell, sum(exp(v) - 1) AS m FROM expr GROUP BY cell) SELECT cell, gene, round(ln(1 + (exp(v) - 1) * 1e4 / m), 6) + 0.0 AS value FROM expr JOIN s USING (cell) WHERE m > 0")
def p2_restore_cp10k(t: Tables) -> DataFrame:
    return _long(t, matrix.restore_cp10k(F.col("x")))


@query(f"WITH {EXPR}, s AS (SELECT cell, sum(exp(least(v, 50)) - 1) AS m FROM expr GROUP BY cell) SELECT cell, gene, round(ln(1 + CASE WHEN m > 0 THEN (exp(least(v, 50)) - 1) * 500 / m ELSE exp(least(v, 50)) - 1 END), 6) + 0.0 AS value FROM expr JOIN s USING (cell)")
def p3_to_library(t: Tables) -> DataFrame:
    return _long(t, matrix.to_library(F.col("x"), F.lit(500.0)))


@query(f"WITH {EXPR}, s AS (SELECT cell, sum(exp(v) - 1) AS m FROM expr GROUP BY cell) SELECT cell, abs(m - 1e4) <= 0.02 + 1e-5 * 1e4 AS raw_closed, m > 0 AS restored_closed FROM s")
def p4_closed_units(t: Tables) -> DataFrame:
    return t.cells().select("cell", matrix.is_closed(F.col("x")).alias("raw_closed"), F.coalesce(matrix.is_closed(matrix.restore_cp10k(F.col("x"))), F.lit(False)).alias("restored_closed"))


@query(f"WITH {EXPR}, s AS (SELECT cell, sum(v) AS m FROM expr GROUP BY cell) SELECT cell, gene, round(CASE WHEN m > 0 THEN v * 100 / m ELSE v END, 6) + 0.0 AS value FROM expr JOIN s USING (cell)")
def p5_library_scale(t: Tables) -> DataFrame:
    return _long(t, matrix.library_scaled(F.col("x"), F.lit(100.0)))


@query(f"WITH {EXPR}, s AS (SELECT cell, sqrt(sum(v * v)) AS m FROM expr GROUP BY cell) SELECT cell, gene, round(v / CASE WHEN m > 0 THEN m ELSE 1 END, 6) + 0.0 AS value FROM expr JOIN s USING (cell)")
def p6_unit_rows(t: Tables) -> DataFrame:
    return _long(t, matrix.unit_rows(F.col("x")))


@query(f"WITH {EXPR}, q AS (SELECT cell, gene, v, (gene % 5 - 2) / 10.0 AS rate FROM expr) SELECT cell, gene, round(CASE WHEN rate = 0 THEN v ELSE ln(1 + (exp(v) - 1) * exp(rate)) END, 6) + 0.0 AS value FROM q")
def p7_rate_decode(t: Tables) -> DataFrame:
    return t.expr().select("cell", "gene", r(matrix.rate_decoded(F.col("v"), (F.col("gene") % 5 - 2) / F.lit(10.0))).alias("value"))


@query(f"WITH {EXPR}, q AS (SELECT cell, gene, v, least(greatest((gene % 7 - 3) / 2.0, -ln(2)), ln(2)) AS s FROM expr) SELECT cell, gene, round(CASE WHEN s >= 0 THEN v + s ELSE ln(1 + (exp(v) - 1) * exp(s)) END, 6) + 0.0 AS value FROM q")
def p8_bounded_add(t: Tables) -> DataFrame:
    return t.expr().select("cell", "gene", r(matrix.bounded_add(F.col("v"), (F.col("gene") % 7 - 3) / F.lit(2.0))).alias("value"))


@query(f"WITH {EXPR} SELECT state, gene, round(avg(ln(1 + (exp(v) - 1) * exp(0.25))), 6) + 0.0 AS mean, round(min(greatest(v - 0.1, 0)), 6) + 0.0 AS low FROM expr GROUP BY ALL")
def p9_p10_emit_and_clip(t: Tables) -> DataFrame:
    emitted = F.log1p(F.expm1("v") * F.exp(F.lit(0.25)))
    return t.expr().groupBy("state", "gene").agg(r(F.avg(emitted)).alias("mean"), r(F.min(matrix.non_negative(F.col("v") - 0.1))).alias("low"))


@query("SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (), 8) + 0.0 AS cost FROM orders")
def p11_max_normalised(t: Tables) -> DataFrame:
    return matrix.max_normalised(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "c").select("o_orderkey", r("c", 8).alias("cost"))


@query("WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1), d AS (SELECT event_type, quantile_cont(abs(value - m), 0.5) AS d FROM events JOIN m USING (event_type) GROUP BY 1) SELECT event_id, round(least(greatest((value - m) / CASE WHEN 1.4826 * d > 1e-9 THEN 1.4826 * d ELSE 1 END, -6), 6), 6) + 0.0 AS z FROM events JOIN m USING (event_type) JOIN d USING (event_type)")
def p12_robust_scale(t: Tables) -> DataFrame:
    return matrix.robust_scaled(t("events"), "value", ["event_type"]).select("event_id", r("z").alias("z"))


@query("SELECT event_id, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END, 5) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY event_type, user_id % 20)")
def p13_z_scores(t: Tables) -> DataFrame:
    return matrix.z_scored(t("events").withColumn("g", F.col("user_id") % 20), "value", ["event_type", "g"]).select("event_id", r("z", 5).alias("z"))


@query(f"WITH {EXPR} SELECT cell, round(1 / (1 + exp(-(avg(v) FILTER (gene <= 8) - avg(v) FILTER (gene > 8 AND gene <= 16)))), 8) + 0.0 AS score FROM expr GROUP BY cell")
def p14_marker_score(t: Tables) -> DataFrame:
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    rows = t.expr().groupBy("cell").agg(mean(F.col("gene") <= 8).alias("up"), mean((F.col("gene") > 8) & (F.col("gene") <= 16)).alias("down"))
    return rows.select("cell", r(matrix.logistic_score(F.col("up"), F.col("down")), 8).alias("score"))


_TWO = f"WITH {EXPR}, s AS (SELECT state, gene, avg(v) FILTER (stage = 0) AS m0, avg(v) FILTER (stage = 1) AS m1, var_pop(v) FILTER (stage = 0) AS v0, var_pop(v) FILTER (stage = 1) AS v1, count(*) FILTER (stage = 0) AS n0, count(*) FILTER (stage = 1) AS n1 FROM expr GROUP BY ALL), d AS (SELECT *, m1 - m0 AS d, sqrt(v0 / n0 + v1 / n1) AS se FROM s)"


@query(_TWO + " SELECT state, gene, round(se, 8) + 0.0 AS se, round(CASE WHEN se > 0 THEN abs(d / se) / (abs(d / se) + 2) ELSE 0 END, 6) + 0.0 AS weight, round(CASE WHEN d * d + se * se > 0 THEN d * d * d / (d * d + se * se) ELSE 0 END, 8) + 0.0 AS shrunk FROM d WHERE n0 > 0 AND n1 > 0")
def p15_p16_p17_shrinkage(t: Tables) -> DataFrame:
    on = lambda s, f: f(F.when(F.col("stage") == s, F.col("v")))
    rows = t.expr().groupBy("state", "gene").agg(*(on(s, f).alias(f"{n}{s}") for s in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))))
    rows = rows.where("n0 > 0 and n1 > 0").withColumn("d", F.col("m1") - F.col("m0"))
    rows = rows.withColumn("se", matrix.standard_error(F.col("v0"), F.col("n0"), F.col("v1"), F.col("n1")))
    return rows.select("state", "gene", r("se", 8).alias("se"), r(matrix.shrink_weight(F.col("d"), F.col("se"), 2.0)).alias("weight"), r(matrix.variance_shrunk(F.col("d"), F.col("se") * F.col("se")), 8).alias("shrunk"))


@query("WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders) SELECT o_orderkey, round(exp(least(greatest(ln(o_totalprice) - ln(m), -ln(3)), ln(3))), 8) + 0.0 AS weight, round(exp(0.5 * ln(least(greatest(o_totalprice / m, 0.25), 4))), 8) + 0.0 AS growth FROM orders, m")
def p18_p19_bounded_weights(t: Tables) -> DataFrame:
    orders = t("orders")
    rows = orders.crossJoin(F.broadcast(orders.agg(F.percentile("o_totalprice", F.lit(0.5)).alias("m"))))
    cap = math.log(3)
    weight = F.exp(F.least(F.greatest(F.log("o_totalprice") - F.log("m"), F.lit(-cap)), F.lit(cap)))
    growth = F.exp(0.5 * F.log(F.least(F.greatest(F.col("o_totalprice") / F.col("m"), F.lit(0.25)), F.lit(4.0))))
    return rows.select("o_orderkey", r(weight, 8).alias("weight"), r(growth, 8).alias("growth"))


@query("SELECT n_nationkey, round((n_nationkey - 3) / 20.0, 8) + 0.0 AS linear, round((ln(n_nationkey + 1) - ln(4)) / (ln(24) - ln(4)), 8) + 0.0 AS logarithmic, round(CASE WHEN n_nationkey > 23 THEN 1 + 0.5 * ((n_nationkey - 3) / 20.0 - 1) ELSE (n_nationkey - 3) / 20.0 END, 8) + 0.0 AS shrunk FROM nation")
def p20_p21_time_fractions(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    linear = (n - 3) / F.lit(20.0)
    log = (F.log(n + 1) - F.log(F.lit(4.0))) / (F.log(F.lit(24.0)) - F.log(F.lit(4.0)))
    return t("nation").select("n_nationkey", r(linear, 8).alias("linear"), r(log, 8).alias("logarithmic"), r(F.when(n > 23, 1 + 0.5 * (linear - 1)).otherwise(linear), 8).alias("shrunk"))


@query(f"WITH {EXPR}, s AS (SELECT state, gene, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS p, avg(v) AS m FROM expr GROUP BY ALL) SELECT cell, gene, round(CASE WHEN v > 0 AND p > 0 THEN greatest(v + (0.05 - m) / p, 0) ELSE v END, 6) + 0.0 AS value FROM expr JOIN s USING (state, gene)")
def p22_zero_preserving_shift(t: Tables) -> DataFrame:
    entries = t.expr()
    shifts = entries.groupBy("state", "gene").agg((F.lit(0.05) - F.avg("v")).alias("delta"), F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("detected"))
    return matrix.zero_preserving_shift(entries, shifts, ["state", "gene"]).select("cell", "gene", r("v").alias("value"))


@query(f"WITH {EXPR}, s AS (SELECT state, gene, stage, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS p, coalesce(avg(CASE WHEN v > 0 THEN v END), 0) AS m FROM expr GROUP BY ALL), q AS (SELECT a.state, a.gene, (b.p - a.p) * (a.m + b.m) / 2 AS dp, (b.m - a.m) * (a.p + b.p) / 2 AS di FROM s a JOIN s b ON a.state = b.state AND a.gene = b.gene AND a.stage = 0 AND b.stage = 1) SELECT state, gene, round(dp, 8) + 0.0 AS by_probability, round(di, 8) + 0.0 AS by_intensity, round(CASE WHEN sign(dp) = sign(di) THEN dp + di ELSE 0 END, 8) + 0.0 AS agreed FROM q")
def p23_p24_decomposition(t: Tables) -> DataFrame:
    s = mo.detection(t.expr(), ["state", "gene", "stage"]).fillna(0.0, ["positive_mean"])
    a, b = (s.where(F.col("stage") == k).select("state", "gene", F.col("detected").alias(f"p{k}"), F.col("positive_mean").alias(f"m{k}")) for k in (0, 1))
    rows = a.join(b, ["state", "gene"])
    dp = (F.col("p1") - F.col("p0")) * (F.col("m0") + F.col("m1")) / 2
    di = (F.col("m1") - F.col("m0")) * (F.col("p0") + F.col("p1")) / 2
    return rows.select("state", "gene", r(dp, 8).alias("by_probability"), r(di, 8).alias("by_intensity"), r(F.when(F.signum(dp) == F.signum(di), dp + di).otherwise(0.0), 8).alias("agreed"))


@query("SELECT event_id, event_type = 'click' AS is_click, round(greatest(value - 10, 0), 6) + 0.0 AS hinge_10, round(pow(greatest(value - 50, 0), 2), 4) + 0.0 AS hinge_50 FROM events")
def p25_p26_encodings(t: Tables) -> DataFrame:
    one, two = matrix.spline_basis(F.col("value"), [10.0])[0], matrix.spline_basis(F.col("value"), [50.0], 2)[0]
    hot = matrix.one_hot(F.col("event_type"), ["click", "view"])[0] == 1
    return t("events").select("event_id", hot.alias("is_click"), r(one).alias("hinge_10"), r(two, 4).alias("hinge_50"))


@query("SELECT p_partkey, CASE WHEN row_number() OVER w > 1 THEN p_name || '__dup' || (row_number() OVER w - 1) ELSE p_name END AS unique_name FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def p27_deduplicated_names(t: Tables) -> DataFrame:
    return matrix.deduplicated_names(t("part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("SELECT p_partkey, len(list_filter(list_transform(string_split(p_name || '; ;' || p_brand, ';'), lambda x: trim(x)), lambda x: x <> '')) AS n_tokens, list_filter(list_transform(string_split(p_name || '; ;' || p_brand, ';'), lambda x: trim(x)), lambda x: x <> '')[2] AS second FROM part")
def p28_tokens(t: Tables) -> DataFrame:
    parts = matrix.tokens(F.concat("p_name", F.lit("; ;"), "p_brand"))
    return t("part").select("p_partkey", F.size(parts).cast("long").alias("n_tokens"), F.element_at(parts, 2).alias("second"))


@query("WITH q AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'nan' WHEN 4 THEN '' ELSE CAST(event_id AS VARCHAR) || '.5' END AS s FROM events) SELECT event_id, CASE WHEN lower(trim(s)) IN ('1', 'true', 'yes', 'y') THEN true WHEN lower(trim(s)) IN ('0', 'false', 'no', 'n') THEN false END AS flag, CASE WHEN isfinite(TRY_CAST(nullif(trim(s), '') AS DOUBLE)) THEN TRY_CAST(nullif(trim(s), '') AS DOUBLE) END AS number FROM q")
def p29_lenient_parse(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    s = F.when(k == 0, " Yes").when(k == 1, "no").when(k == 2, "1").when(k == 3, "nan").when(k == 4, "").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return t("events").withColumn("s", s).select("event_id", matrix.lenient_bool(F.col("s")).alias("flag"), matrix.lenient_double(F.col("s")).alias("number"))


@query("SELECT o_orderpriority, sha256(string_agg(d, '' ORDER BY d)) AS digest, count(*) AS n_rows FROM (SELECT o_orderpriority, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS d FROM orders) GROUP BY 1")
def p31_p32_digests(t: Tables) -> DataFrame:
    return matrix.digest(t("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderpriority"])


@query("SELECT n_nationkey, CAST('0x' || substr(sha256('7:' || n_name), 1, 15) AS BIGINT) AS seed FROM nation")
def p33_derived_seed(t: Tables) -> DataFrame:
    return t("nation").select("n_nationkey", matrix.derived_seed(F.lit(7), F.col("n_name")).alias("seed"))


@query("SELECT count(*) AS n, max(c_acctbal) + 0.0 AS top FROM customer")
def p30_column_by_alias(t: Tables) -> DataFrame:
    rows = t("customer")
    value = matrix.first_present(rows.columns, ["balance", "C_ACCTBAL", "c_custkey"])
    return rows.agg(F.count("*").alias("n"), (F.max(value) + 0.0).alias("top"))


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)') AND NOT regexp_matches(lower(text), 'license|copyright') AND lang IN ('en', 'de')")
def f1_text_firewall(t: Tables) -> DataFrame:
    return filters.firewall(t("documents"), "text", required=r"(^|[^a-z])the([^a-z]|$)", forbidden="license|copyright").where(F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query("SELECT p_partkey, len(list_filter(string_split_regex(upper(p_type), '[+;,/ |]+'), lambda x: x IN ('STEEL', 'BRASS'))) > 0 OR regexp_matches(p_brand, '#1') AS forbidden FROM part")
def f2_forbidden_tokens(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", (filters.has_forbidden(F.col("p_type"), ["STEEL", "BRASS"]) | F.col("p_brand").rlike("#1")).alias("forbidden"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0)")
def f3_blacklist(t: Tables) -> DataFrame:
    black = t("customer").where("c_mktsegment = 'BUILDING' or c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(black, "o_custkey", "left_anti").select("o_orderkey")


@query(f"WITH {EXPR} SELECT cell, round(sum(v), 6) + 0.0 AS library, count(*) FILTER (v > 0) AS genes FROM expr GROUP BY cell HAVING sum(v) >= 2.5 AND count(*) FILTER (v > 0) >= 28 AND sum(v) FILTER (gene <= 3) / sum(v) <= 0.1")
def f4_cell_calling(t: Tables) -> DataFrame:
    return filters.called_cells(t.expr(), least_sum=2.5, least_genes=28, marked=F.col("gene") <= 3, most_share=0.1).select("cell", r("library").alias("library"), "genes")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY 1")
def f5_membership(t: Tables) -> DataFrame:
    wanted = t("part").where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").join(wanted, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, n AS (SELECT state, count(*) FILTER (stage = 0) AS n0, count(*) FILTER (stage = 1) AS n1 FROM cells GROUP BY 1) SELECT cell, state FROM cells WHERE state IN (SELECT state FROM n WHERE n0 >= 22 AND n1 >= 22)")
def f6_low_support(t: Tables) -> DataFrame:
    return filters.supported(t.cells(), "state", "stage", [0, 1], 22).select("cell", "state")


@query(f"WITH {EXPR}, s AS (SELECT gene, avg(v) FILTER (stage = 0) AS a, avg(v) FILTER (stage = 1) AS b FROM expr GROUP BY 1) SELECT gene, NOT (starts_with('g' || gene, 'g1') OR gene IN (20, 30) OR b / a > 1.2) AS trusted FROM s")
def f7_gene_trust(t: Tables) -> DataFrame:
    s = t.expr().groupBy("gene").agg(F.avg(F.when(F.col("stage") == 0, F.col("v"))).alias("a"), F.avg(F.when(F.col("stage") == 1, F.col("v"))).alias("b"))
    name = F.concat(F.lit("g"), F.col("gene").cast("string"))
    return s.select("gene", filters.trusted(name, ["g1"], ["g20", "g30"], F.col("b") / F.col("a"), 1.2).alias("trusted"))


@query("SELECT event_type, bool_and(isfinite(value) AND value >= 0) AS sound, count(*) FILTER (NOT (isfinite(value) AND value >= 0)) AS n_bad FROM events GROUP BY 1")
def f8_finite_non_negative(t: Tables) -> DataFrame:
    good = filters.finite_non_negative(F.col("value"))
    return t("events").groupBy("event_type").agg(F.bool_and(good).alias("sound"), F.count_if(~good).alias("n_bad"))


@query(f"WITH {EXPR}, s AS (SELECT gene, avg(v) AS m, var_pop(v) AS s2 FROM expr GROUP BY 1) SELECT gene, round(s2 / m, 8) + 0.0 AS dispersion FROM s WHERE m > 0.02 ORDER BY s2 / m DESC, gene LIMIT 20")
def f9_variable_genes(t: Tables) -> DataFrame:
    return filters.variable_genes(t.expr(), 0.02, 20).select("gene", r("dispersion", 8).alias("dispersion"))


@query(f"WITH {EXPR}, c AS (SELECT a.gene, corr(a.v, b.v) AS rho FROM expr a JOIN expr b ON a.cell = b.cell AND b.gene = 1 AND a.gene > 1 GROUP BY 1), m AS (SELECT quantile_cont(abs(rho), 0.5) AS m FROM c WHERE rho <> 0) SELECT gene, round(rho, 6) + 0.0 AS rho FROM c, m WHERE abs(rho) > m")
def f10_correlation_support(t: Tables) -> DataFrame:
    return filters.correlated_with(t.expr(), 1).select("gene", r("rho").alias("rho"))


@query(f"WITH {CELLS} SELECT (SELECT count(*) FROM cells a WHERE stage = 0 AND EXISTS (SELECT 1 FROM cells b WHERE b.stage = 1 AND b.cell = a.cell)) AS leaked, count(*) AS n FROM cells WHERE stage = 0")
def f11_leak_guard(t: Tables) -> DataFrame:
    cells = t.cells()
    sources, target = cells.where("stage = 0").select("cell"), cells.where("stage = 1").select("cell")
    return sources.join(target.withColumn("hit", F.lit(1)), "cell", "left").agg(F.count("hit").alias("leaked"), F.count("*").alias("n"))


@query("SELECT event_id, value FROM events WHERE event_type IN ('click', 'purchase')")
def f12_query_filter(t: Tables) -> DataFrame:
    return t("events").where("event_type in ('click', 'purchase')").select("event_id", "value")
