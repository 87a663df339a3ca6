"""Queries of joins, set operations (2.8), evidence and graphs (2.5, 2.11), contracts (2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import contracts, evidence, joins

from .registry import EXPR, POINTS, Tables, query, r


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS r FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1) SELECT count(*) FILTER (l > 1) AS duplicate_left, count(*) FILTER (r > 1) AS duplicate_right, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (l = 1 AND r = 1) AS pairs FROM a FULL JOIN b USING (k)")
def j1_one_to_one_checks(t: Tables) -> DataFrame:
    return joins.one_to_one(t("orders").select(F.col("o_custkey").alias("k")), t("customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT count(*) FILTER (o_orderkey IS NOT NULL) AS matched, count(*) FILTER (o_orderkey IS NULL) AS missing FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def j2_barcode_join(t: Tables) -> DataFrame:
    done = t("orders").where("o_orderstatus = 'F'").select("o_orderkey")
    rows = t("lineitem").select("l_orderkey").join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.agg(F.count("o_orderkey").alias("matched"), F.count_if(F.col("o_orderkey").isNull()).alias("missing"))


@query("WITH s AS (SELECT event_type, user_id % 50 AS g, avg(value) AS m FROM events WHERE user_id % 50 < 40 GROUP BY ALL), g AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_id, round(value - coalesce(s.m, g.m), 6) + 0.0 AS residual FROM events e JOIN g USING (event_type) LEFT JOIN s ON s.event_type = e.event_type AND s.g = e.user_id % 50")
def j3_j4_state_lookup(t: Tables) -> DataFrame:
    e = t("events").withColumn("g", F.col("user_id") % 50)
    own = e.where("g < 40").groupBy("event_type", "g").agg(F.avg("value").alias("m"))
    pooled = e.groupBy("event_type").agg(F.avg("value").alias("p"))
    rows = e.join(own, ["event_type", "g"], "left").join(pooled, "event_type")
    return rows.select("event_id", r(F.col("value") - F.coalesce("m", "p")).alias("residual"))


_GATES = "gates AS (SELECT * FROM (VALUES ('BUILDING', 'N1', 'S1', 0.9), ('BUILDING', '', 'S1', 0.8), ('', 'N1', 'S2', 0.7), ('', '', 'S1', 0.6), ('', '', 'S3', 0.5)) g(cond, stage, state, gate))"


@query(f"WITH {_GATES}, c AS (SELECT c_custkey, c_mktsegment AS cond, 'N' || c_nationkey % 3 AS stage, 'S' || c_custkey % 5 AS state FROM customer) SELECT c_custkey, coalesce(a.gate, b.gate, d.gate, e.gate) + 0.0 AS gate, CASE WHEN a.gate IS NOT NULL THEN 0 WHEN b.gate IS NOT NULL THEN 1 WHEN d.gate IS NOT NULL THEN 2 WHEN e.gate IS NOT NULL THEN 3 END AS level FROM c LEFT JOIN gates a ON a.cond = c.cond AND a.stage = c.stage AND a.state = c.state LEFT JOIN gates b ON b.cond = c.cond AND b.stage = '' AND b.state = c.state LEFT JOIN gates d ON d.cond = '' AND d.stage = c.stage AND d.state = c.state LEFT JOIN gates e ON e.cond = '' AND e.stage = '' AND e.state = c.state")
def j5_prioritised_fallback(t: Tables) -> DataFrame:
    gates = t.spark.sql("SELECT * FROM VALUES ('BUILDING', 'N1', 'S1', 0.9D), ('BUILDING', '', 'S1', 0.8D), ('', 'N1', 'S2', 0.7D), ('', '', 'S1', 0.6D), ('', '', 'S3', 0.5D) AS g(cond, stage, state, gate)")
    c = t("customer").select("c_custkey", F.col("c_mktsegment").alias("cond"), F.concat(F.lit("N"), (F.col("c_nationkey") % 3).cast("string")).alias("stage"), F.concat(F.lit("S"), (F.col("c_custkey") % 5).cast("string")).alias("state"))
    levels = [["cond", "stage", "state"], ["cond", "state"], ["stage", "state"], ["state"]]
    return joins.prioritised(c, gates, ["cond", "stage", "state"], "gate", levels).select("c_custkey", "gate", "level")


@query("WITH f AS (SELECT p_partkey, s_suppkey, n_name FROM part JOIN supplier ON p_size % 25 = s_nationkey JOIN nation ON s_nationkey = n_nationkey) SELECT p_partkey, s_suppkey, n_name, count(*) OVER (PARTITION BY p_partkey) > 1 AS mapping_collision FROM f")
def j6_fan_out(t: Tables) -> DataFrame:
    """Parts by their nation's suppliers: how many a part meets is known before it meets them, so that only parts are shuffled."""
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("_k"), "s_suppkey", "n_name")
    met = s.groupBy("_k").agg(F.count("*").alias("_n"))
    parts = t("part").select("p_partkey", (F.col("p_size") % 25).alias("_k")).join(met, "_k")
    parts = parts.withColumn("mapping_collision", F.sum("_n").over(Window.partitionBy("p_partkey")) > 1)
    return parts.join(s, "_k").select("p_partkey", "s_suppkey", "n_name", "mapping_collision")


_CENTRES = f"WITH {EXPR}, cen AS (SELECT state, gene, avg(v) AS m FROM expr WHERE stage = 0 GROUP BY ALL)"


def _centres(t: Tables) -> DataFrame:
    m = t.expr().where("stage = 0").groupBy("state", "gene").agg(F.avg("v").alias("m"))
    wide = m.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("gene", "m"))).alias("r"))
    return wide.select("state", F.transform("r", lambda p: p["m"]).alias("centre"))


@query(_CENTRES + ", s AS (SELECT e.cell, c.state, round(sum(v * m) / sqrt(sum(v * v) * sum(m * m)), 9) AS s FROM expr e JOIN cen c USING (gene) WHERE e.stage = 1 GROUP BY ALL) SELECT cell, CAST(arg_min(state, (-s, state)) AS INTEGER) AS nearest_state, max(s) + 0.0 AS score FROM s GROUP BY 1")
def j7_nearest_centroid(t: Tables) -> DataFrame:
    cos = lambda a, b: joins.dot(a, b) / F.sqrt(joins.dot(a, a) * joins.dot(b, b))
    return joins.nearest(t.cells().where("stage = 1"), _centres(t), "x", "state", "centre", cos, "cell")


@query(_CENTRES + ", s AS (SELECT e.cell, c.state, round(corr(v, m), 9) AS s FROM expr e JOIN cen c USING (gene) WHERE e.stage = 1 GROUP BY ALL) SELECT cell, CAST(arg_max(state, (s, state)) AS INTEGER) AS nearest_state, max(s) + 0.0 AS score FROM s GROUP BY 1")
def j8_correlation_match(t: Tables) -> DataFrame:
    def corr(a, b):
        n = F.size(a)
        ma, mb = (F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n for x in (a, b))
        a, b = F.transform(a, lambda v: v - ma), F.transform(b, lambda v: v - mb)
        return joins.dot(a, b) / F.sqrt(joins.dot(a, a) * joins.dot(b, b))

    return joins.nearest(t.cells().where("stage = 1"), _centres(t), "x", "state", "centre", corr, "cell", largest_name=True)


@query(f"WITH {EXPR}, m AS (SELECT state, stage, gene, avg(v) AS m FROM expr GROUP BY ALL), p AS (SELECT a.state AS a, b.state + 3 AS b, round(sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 9) AS s FROM m a JOIN m b ON a.gene = b.gene AND a.stage = 0 AND b.stage = 1 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS rb FROM p) SELECT a, CASE WHEN max((a = b)::INT) = 1 THEN max(CASE WHEN a = b THEN b END) ELSE max(CASE WHEN ra = 1 AND rb = 1 AND s >= 0.9 THEN b END) END AS match, CASE WHEN max((a = b)::INT) = 1 THEN 'SHARED_EXACT' WHEN max(CASE WHEN ra = 1 AND rb = 1 AND s >= 0.9 THEN b END) IS NOT NULL THEN 'MUTUAL' ELSE 'UNRESOLVED' END AS status FROM k GROUP BY 1")
def j9_crosswalk(t: Tables) -> DataFrame:
    m = t.expr().groupBy("state", "stage", "gene").agg(F.avg("v").alias("m"))
    a, b = (m.where(F.col("stage") == s).select(F.col("state").alias(n), "gene", F.col("m").alias(f"m{n}")) for s, n in ((0, "a"), (1, "b")))
    s = F.round(F.sum(F.col("ma") * F.col("mb")) / F.sqrt(F.sum(F.col("ma") * F.col("ma")) * F.sum(F.col("mb") * F.col("mb"))), 9)
    pairs = a.join(b, "gene").groupBy("a", "b").agg(s.alias("s")).withColumn("b", F.col("b") + 3)
    return joins.crosswalk(pairs, "a", "b", "s", 0.9)


@query(_CENTRES + ", s AS (SELECT e.cell, c.state, round(-sum((v - m) * (v - m)), 9) AS s FROM expr e JOIN cen c USING (gene) WHERE e.stage = 1 GROUP BY ALL) SELECT cell, CAST(arg_min(state, (-s, state)) AS INTEGER) AS nearest_state, max(s) + 0.0 AS score FROM s GROUP BY 1")
def j10_j11_euclidean_centroid(t: Tables) -> DataFrame:
    return joins.nearest(t.cells().where("stage = 1"), _centres(t), "x", "state", "centre", lambda a, b: -joins.squared_distance(a, b), "cell")


_NEAR = f"WITH {POINTS}, d AS (SELECT a.state, a.cell AS src, b.cell AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM points a JOIN points b USING (state))"


@query(_NEAR + " SELECT src, dst, round(dist, 6) + 0.0 AS dist, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY (src <> dst)::INT, round(dist, 9), dst) AS k FROM d) WHERE k <= 4")
def j12_neighbours_with_self(t: Tables) -> DataFrame:
    return joins.neighbours(t.points(), 4, ["state"], keep_self=True).select("src", "dst", r("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(_NEAR + " SELECT src, dst, round(dist, 6) + 0.0 AS dist, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS k FROM d WHERE src <> dst) WHERE k <= 3")
def j13_j16_j18_neighbours(t: Tables) -> DataFrame:
    return joins.neighbours(t.points(), 3, ["state"]).select("src", "dst", r("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(_NEAR + " SELECT src, count(*) AS n, round(sum(exp(-dist)), 6) + 0.0 AS mass FROM d WHERE dist <= 0.15 GROUP BY 1")
def j14_radius_join(t: Tables) -> DataFrame:
    return joins.in_range(t.points(), 0.15, ["state"]).groupBy("src").agg(F.count("*").alias("n"), r(F.sum(F.exp(-F.col("dist")))).alias("mass"))


@query("WITH d AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, arg_max(p_partkey, (p_retailprice, -p_partkey)) OVER (PARTITION BY p_brand) AS donor FROM part) SELECT p_partkey, donor, b.p_retailprice + 0.0 AS price FROM d JOIN part b ON b.p_partkey = donor AND b.p_brand = d.p_brand".replace("SELECT p_partkey, donor", "SELECT d.p_partkey, donor"))
def j17_donor_replace(t: Tables) -> DataFrame:
    part = t("part")
    donor = part.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("donor"))
    values = part.select(F.col("p_partkey").alias("donor"), "p_brand", F.col("p_retailprice").alias("price"))
    return part.select("p_partkey", "p_brand").join(donor, "p_brand").join(values, ["donor", "p_brand"]).select("p_partkey", "donor", "price")


@query("WITH f AS (SELECT p_name, min(p_partkey) AS p_partkey, count(*) AS n FROM part GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(f.p_partkey, -1) AS resolved, coalesce(f.n, 0) AS n_names FROM lineitem LEFT JOIN part p ON l_partkey = p.p_partkey AND p.p_size <= 40 LEFT JOIN f ON f.p_name = p.p_name")
def j19_j20_alias_resolution(t: Tables) -> DataFrame:
    part = t("part")
    first = part.groupBy("p_name").agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))
    named = part.where("p_size <= 40").join(first, "p_name").select(F.col("p_partkey").alias("l_partkey"), "first", "n")
    rows = t("lineitem").join(named, "l_partkey", "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("first", F.lit(-1)).alias("resolved"), F.coalesce("n", F.lit(0)).alias("n_names"))


@query("WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1) SELECT user_id, round(a - b, 6) + 0.0 AS delta FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def j21_paired_delta(t: Tables) -> DataFrame:
    m = t("events").groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.avg("value"))
    return m.where("click is not null and purchase is not null").select("user_id", r(F.col("click") - F.col("purchase")).alias("delta"))


@query("SELECT (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 11 <> 0)) AS only_parent, (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 11 <> 0 EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders)) AS only_candidate")
def j22_u4_equality(t: Tables) -> DataFrame:
    parent = t("orders").select("o_orderkey", "o_custkey")
    return contracts.set_difference(parent, parent.where("o_orderkey % 11 <> 0"), "only_parent", "only_candidate")


@query("SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS semi, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS anti FROM customer")
def j23_semi_anti(t: Tables) -> DataFrame:
    keys = t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    return t("customer").join(keys, "c_custkey", "left").agg(F.count("hit").alias("semi"), F.count_if(F.col("hit").isNull()).alias("anti"))


@query("WITH m AS (SELECT user_id, ts, max(value) AS mark FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.event_id, round(m.mark, 6) + 0.0 AS mark FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts")
def j24_bracket_search(t: Tables) -> DataFrame:
    events = t("events")
    marks = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("mark"))
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return joins.bracketed(clicks, marks, ["user_id"], "ts", "mark").select("event_id", r("mark").alias("mark"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def u1_union(t: Tables) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_union, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_shared, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_missing, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) = 0 AS disjoint")
def u2_u3_u5_vocabularies(t: Tables) -> DataFrame:
    sides = t("lineitem").where("l_returnflag in ('A', 'R')").groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    shared = F.count_if(F.col("a") & F.col("b"))
    return sides.agg(F.count("*").alias("n_union"), shared.alias("n_shared"), F.count_if(F.col("a") & ~F.col("b")).alias("n_missing"), (shared == 0).alias("disjoint"))


_VOTES = "votes AS (SELECT d.source AS target, d.lang AS family, 'k' || d.doc_id % 12 AS response, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 WHEN l.toxic = 1 THEN -1 ELSE 0 END AS sign, (d.n_chars % 100) / 100.0 AS rank_score, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE (d.doc_id % 10) / 10.0 END AS confidence, (d.doc_id % 7) / 7.0 AS directness, d.doc_id % 4 <> 0 AS gate FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"


def _votes(t: Tables) -> DataFrame:
    rows = t("labels").where("quality is not null").join(t("documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    sign = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("toxic") == 1, -1).otherwise(0)
    key = F.concat(F.lit("k"), (F.col("doc_id") % 12).cast("string"))
    return rows.select(
        F.col("source").alias("target"), F.col("lang").alias("family"), key.alias("response"), sign.alias("sign"), (F.col("n_chars") % 100 / 100).alias("rank_score"),
        F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 10 / 10).alias("confidence"), (F.col("doc_id") % 7 / 7).alias("directness"), (F.col("doc_id") % 4 != 0).alias("gate"),
    )


@query(f"WITH {_VOTES}, g AS (SELECT target, response, count(DISTINCT family) AS families, count(DISTINCT CASE WHEN sign <> 0 THEN sign END) > 1 AS conflict, max(CASE WHEN sign <> 0 THEN sign END) AS sign, avg(rank_score) AS rank, avg(confidence) AS confidence, max(directness) AS directness, bool_or(gate) AS gate, array_to_string(list_sort(list(DISTINCT family)), ';') AS provenance FROM votes GROUP BY ALL), q AS (SELECT *, CASE WHEN conflict THEN 'SIGN_CONFLICT' WHEN sign IS NULL THEN 'NO_SIGN' WHEN families < 1 THEN 'TOO_FEW_FAMILIES' WHEN NOT gate THEN 'GATE_CLOSED' ELSE 'PASS' END AS why FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY (why <> 'PASS')::INT, round(rank, 9) DESC, round(coalesce(confidence, -1), 9) DESC, response) AS k FROM q) SELECT target, response, families, conflict, round(rank, 6) + 0.0 AS rank, round(confidence, 6) + 0.0 AS confidence, provenance, CASE WHEN why = 'PASS' AND k > 4 THEN 'CAP_EXCLUDED' ELSE why END AS reason FROM k")
def a19_committee(t: Tables) -> DataFrame:
    rows = evidence.committee(_votes(t), ["target", "response"], 1, 4, "target")
    return rows.select("target", "response", "families", "conflict", r("rank").alias("rank"), r("confidence").alias("confidence"), "provenance", "reason")


@query(f"WITH {_VOTES}, c AS (SELECT target, count(DISTINCT sign) > 1 AS conflict FROM votes WHERE sign <> 0 GROUP BY 1) SELECT target, count(*) AS n, sum(CASE WHEN coalesce(conflict, false) THEN 0 ELSE sign END)::BIGINT AS sum_sign, sum(sign)::BIGINT AS raw_sum FROM votes LEFT JOIN c USING (target) GROUP BY 1")
def a20_conflicts(t: Tables) -> DataFrame:
    return evidence.conflicts(_votes(t), ["target"]).groupBy("target").agg(F.count("*").alias("n"), F.sum("sign").alias("sum_sign"), F.sum("raw_sign").alias("raw_sum"))


_STATUS = "CASE WHEN count(DISTINCT CASE WHEN sign <> 0 THEN family END) = 0 THEN 'NO_EVIDENCE' WHEN count(DISTINCT CASE WHEN sign <> 0 THEN sign END) > 1 THEN 'CONFLICT' WHEN count(DISTINCT CASE WHEN sign <> 0 THEN family END) = 1 THEN 'SINGLE' ELSE 'SUPPORTED' END AS status"


@query(f"WITH {_VOTES}, f AS (SELECT DISTINCT family AS held_out FROM votes), g AS (SELECT DISTINCT target FROM votes) SELECT g.target, held_out, count(DISTINCT CASE WHEN sign <> 0 THEN family END) AS families, {_STATUS} FROM g CROSS JOIN f LEFT JOIN votes v ON v.target = g.target AND v.family <> held_out GROUP BY ALL")
def a21_leave_one_family_out(t: Tables) -> DataFrame:
    return evidence.without_family(_votes(t), "target")


@query(f"WITH {_VOTES} SELECT target, count(DISTINCT CASE WHEN sign <> 0 THEN family END) AS families, {_STATUS} FROM votes GROUP BY 1")
def a22_claims(t: Tables) -> DataFrame:
    return evidence.claims(_votes(t), "target")


_LEDGER = "ledger AS (SELECT event_type AS board, user_id AS version, CASE WHEN event_id % 5 = 0 THEN 'scored' WHEN event_id % 5 = 1 THEN 'draft' ELSE 'final' END AS status, CASE event_id % 17 WHEN 0 THEN 'NaN' WHEN 1 THEN '' WHEN 2 THEN 'pending' WHEN 3 THEN 'inf' ELSE CAST(round(value) AS VARCHAR) END AS server_score, event_id AS idx FROM events)"


def _ledger(t: Tables) -> DataFrame:
    k = F.col("event_id") % 17
    score = F.when(k == 0, "NaN").when(k == 1, "").when(k == 2, "pending").when(k == 3, "inf").otherwise(F.round("value").cast("string"))
    status = F.when(F.col("event_id") % 5 == 0, "scored").when(F.col("event_id") % 5 == 1, "draft").otherwise("final")
    return t("events").select(F.col("event_type").alias("board"), F.col("user_id").alias("version"), status.alias("status"), score.alias("server_score"), F.col("event_id").alias("idx"))


@query(f"WITH {_LEDGER}, s AS (SELECT *, TRY_CAST(server_score AS DOUBLE) AS score FROM ledger WHERE status IN ('scored', 'final')), k AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY score DESC, idx) AS k FROM s WHERE isfinite(score)) SELECT board, version, idx, round(score, 6) + 0.0 AS score FROM k WHERE k = 1")
def a23_board_maximum(t: Tables) -> DataFrame:
    return evidence.board_maximum(_ledger(t), ["scored", "final"]).select("board", "version", "idx", r("score").alias("score"))


_EDGES = "e AS (SELECT DISTINCT 'P' || a.l_partkey AS src, 'p' || b.l_partkey AS dst, CASE WHEN a.l_returnflag <> 'N' AND a.l_linestatus = 'O' THEN 1 WHEN a.l_returnflag <> 'N' THEN -1 END AS sign FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def _edges(t: Tables) -> DataFrame:
    """Parts that follow each other in an order, as signed edges: a graph that grows with the table."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    directed, up = F.col("l_returnflag") != "N", F.col("l_linestatus") == "O"
    a = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("at"), name("P", "l_partkey").alias("src"), evidence.edge_sign(directed, up, ~up).alias("sign"))
    b = t("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("at"), name("p", "l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "at"]).select("src", "dst", "sign").distinct()


@query(f"WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT lower(src) AS src, lower(dst) AS dst, sign FROM e WHERE sign IS NOT NULL), p AS (SELECT DISTINCT src AS source, src AS target, 0 AS hops, [src] AS path, 1 AS sign FROM s WHERE src IN ('p1', 'p2', 'p3') UNION ALL SELECT source, s.dst, hops + 1, list_append(path, s.dst), p.sign * s.sign FROM p JOIN s ON s.src = p.target WHERE hops < 3 AND NOT list_contains(path, s.dst)) SELECT source, target, hops, array_to_string(path, '>') AS path, sign FROM p WHERE hops > 0")
def x22_signed_paths(t: Tables) -> DataFrame:
    sources = t.spark.sql("SELECT * FROM VALUES ('P1'), ('P2'), ('P3') AS s(src)")
    return evidence.signed_paths(_edges(t), sources, 3)


@query(f"WITH {_EDGES} SELECT lower(src) AS src, lower(dst) AS dst, -max(sign) AS effect, count(DISTINCT sign) > 1 AS conflict, count(*) FILTER (sign IS NULL) > 0 AS unresolved FROM e GROUP BY 1, 2")
def x23_x24_edge_evidence(t: Tables) -> DataFrame:
    rows = _edges(t).withColumns({"src": F.lower("src"), "dst": F.lower("dst")})
    return rows.groupBy("src", "dst").agg((-F.max("sign")).alias("effect"), (F.count_distinct("sign") > 1).alias("conflict"), (F.count_if(F.col("sign").isNull()) > 0).alias("unresolved"))


@query("WITH RECURSIVE b AS (SELECT DISTINCT n_nationkey AS child, n_nationkey // 2 AS parent FROM nation WHERE n_nationkey > 0), c AS (SELECT child, parent FROM b UNION SELECT c.child, b.parent FROM c JOIN b ON c.parent = b.child) SELECT child, parent FROM c")
def s14_closure(t: Tables) -> DataFrame:
    edges = t("nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("child"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("parent"))
    return evidence.closure(edges)


@query("SELECT event_id, CASE WHEN p IS NULL THEN 'FIRST' WHEN abs(s - p) <= 5 THEN 'KEEP' WHEN s > p THEN 'PROMOTE' ELSE 'REJECT' END AS decision, CASE WHEN (value - 50) / 50 > 0.05 THEN 'IMPROVE' WHEN (value - 50) / 50 < -0.05 THEN 'DEGRADE' ELSE 'TIER' END AS class FROM (SELECT event_id, value, round(value, 4) AS s, lag(round(value, 4)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM events)")
def q21_q26_ladder_and_tie_band(t: Tables) -> DataFrame:
    rows = t("events").withColumn("s", F.round("value", 4))
    rows = evidence.tie_band(rows, ["event_type", "user_id"], ["ts", "event_id"], "s", 5.0)
    return rows.select("event_id", "decision", evidence.ladder(F.col("value"), F.lit(50.0)).alias("class"))


@query(f"WITH {EXPR}, c AS (SELECT 'unique_cells' AS name, count(*) - count(DISTINCT cell) AS bad FROM cells UNION ALL SELECT 'finite', count(*) FILTER (NOT isfinite(v)) FROM expr UNION ALL SELECT 'non_negative', count(*) FILTER (v < 0) FROM expr UNION ALL SELECT 'state_present', count(*) FILTER (state IS NULL) FROM cells UNION ALL SELECT 'width', count(*) FILTER (len(e) <> 64) FROM cells UNION ALL SELECT 'cell_range', CASE WHEN count(*) BETWEEN 100 AND 400 THEN 0 ELSE 1 END FROM cells) SELECT name, bad, bad = 0 AS passed FROM c")
def v1_v2_contract(t: Tables) -> DataFrame:
    return contracts.matrix_contract(t.cells(), width=64, least_cells=100, most_cells=400)


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AND max(l_linenumber) = count(*) AND min(l_linenumber) = 1 AS bijection FROM lineitem GROUP BY 1")
def v6_bijection(t: Tables) -> DataFrame:
    """Of each order, whether its lines' numbers are 1 to as many as there are."""
    return contracts.bijection(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query("WITH a AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0 OR o_orderpriority <> '1-URGENT' GROUP BY 1) SELECT o_orderpriority, a.n AS before, coalesce(b.n, 0) AS after, a.n = coalesce(b.n, 0) AS conserved FROM a LEFT JOIN b USING (o_orderpriority)")
def v4_v7_conservation(t: Tables) -> DataFrame:
    orders = t("orders")
    return contracts.conserved(orders, orders.where("o_orderkey % 50 <> 0 or o_orderpriority <> '1-URGENT'"), "o_orderpriority")
