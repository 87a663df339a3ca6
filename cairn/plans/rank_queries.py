"""Queries of ranks and windows, sorts and top-k (2.7), sampling and allocation (2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import alloc, ranks
from cairn.operators import moments as mo

from .registry import CELLS, EXPR, Tables, query, r


@query(f"WITH {EXPR} SELECT cell, gene, round((rank() OVER (PARTITION BY state, gene ORDER BY v) + (count(*) OVER (PARTITION BY state, gene, v) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY state, gene), 8) + 0.0 AS u FROM expr")
def w1_normalised_rank(t: Tables) -> DataFrame:
    return t.expr().select("cell", "gene", r(ranks.normalised_rank("v", ["state", "gene"]), 8).alias("u"))


@query("SELECT event_id, round((count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50) DESC, event_id) + 1) / (count(*) OVER (PARTITION BY event_type) + 1), 8) + 0.0 AS score FROM events")
def w2_w3_effect_score(t: Tables) -> DataFrame:
    return t("events").withColumn("e", F.col("value") - 50).select("event_id", r(ranks.effect_score("e", ["event_type"], "event_id"), 8).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, md5('9:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), l_extendedprice) AS k FROM lineitem")
def w4_jittered_rank(t: Tables) -> DataFrame:
    rows = t("lineitem").withColumn("h", alloc.hash_order(9, "l_orderkey", "l_linenumber", "l_partkey"))
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_quantity", "h", "l_extendedprice"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", k.cast("long").alias("k"))


@query("WITH s AS (SELECT user_id, event_id, coalesce(sqrt(pow(value - lag(value) OVER w, 2) + pow(event_id - lag(event_id) OVER w, 2)), 0) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT event_id, ts FROM events) SELECT event_id, round(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS arc FROM s JOIN t USING (event_id)")
def w6_arc_length(t: Tables) -> DataFrame:
    return ranks.arc_length(t("events"), ["user_id"], ["ts", "event_id"], "value", "event_id").select("event_id", r("arc", 4).alias("arc"))


@query("SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS high FROM events")
def w7_running_maximum(t: Tables) -> DataFrame:
    return t("events").select("event_id", r(ranks.running_maximum("value", ["user_id"], ["ts", "event_id"])).alias("high"))


@query("WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY ALL), s AS (SELECT event_type, day, ln(m) - ln(lag(m) OVER (PARTITION BY event_type ORDER BY day)) AS s FROM d) SELECT event_type, round(least(greatest(arg_max(s, day), min(s)), max(s)), 8) + 0.0 AS last_slope, round(max(s), 8) + 0.0 AS high FROM s WHERE s IS NOT NULL GROUP BY 1")
def w8_adjacent_slope(t: Tables) -> DataFrame:
    d = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    s = d.withColumn("s", F.log("m") - F.log(F.lag("m").over(Window.partitionBy("event_type").orderBy("day")))).where("s is not null")
    return s.groupBy("event_type").agg(r(F.least(F.greatest(F.max_by("s", "day"), F.min("s")), F.max("s")), 8).alias("last_slope"), r(F.max("s"), 8).alias("high"))


_BRIDGE = f"""WITH {EXPR}, l AS (SELECT state, gene, list(v ORDER BY v) AS l FROM expr WHERE stage = 0 GROUP BY ALL), rr AS (SELECT state, gene, list(v ORDER BY v) AS rl FROM expr WHERE stage = 1 GROUP BY ALL),
u AS (SELECT *, (rank() OVER (PARTITION BY state, gene ORDER BY v) + (count(*) OVER (PARTITION BY state, gene, v) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY state, gene) AS u FROM expr WHERE stage = 0),
a AS (SELECT *, least(greatest(u * len(l) - 0.5, 0), len(l) - 1) AS pa, least(greatest(u * len(rl) - 0.5, 0), len(rl) - 1) AS pb FROM u JOIN l USING (state, gene) JOIN rr USING (state, gene)),
b AS (SELECT *, CAST(floor(pa) AS BIGINT) AS la, CAST(floor(pb) AS BIGINT) AS lb FROM a),
c AS (SELECT *, l[la + 1] + (pa - la) * (l[least(la + 1, len(l) - 1) + 1] - l[la + 1]) AS qa, rl[lb + 1] + (pb - lb) * (rl[least(lb + 1, len(rl) - 1) + 1] - rl[lb + 1]) AS qb FROM b)"""


@query(_BRIDGE + " SELECT cell, gene, round(greatest(0.7 * qa + 0.3 * qb, 0), 6) + 0.0 AS bridged FROM c")
def w9_w10_quantile_bridge(t: Tables) -> DataFrame:
    return ranks.quantile_bridge(t.expr(), 0.3).select("cell", "gene", r("bridged").alias("bridged"))


@query(f"WITH {EXPR}, lib AS (SELECT cell, sum(v) AS library FROM expr GROUP BY 1), q AS (SELECT *, count(*) FILTER (v > 0) OVER w AS p, count(*) OVER w AS n, min(v) FILTER (v > 0) OVER w AS low, row_number() OVER (PARTITION BY state, gene ORDER BY (v > 0) DESC, v DESC, round(library, 9) DESC, cell) AS k FROM expr JOIN lib USING (cell) WINDOW w AS (PARTITION BY state, gene)) SELECT state, gene, count(*) FILTER (d > 0) AS active, round(sum(d), 6) + 0.0 AS total FROM (SELECT state, gene, CASE WHEN k > least(round(p * 1.3), n) THEN 0 WHEN v > 0 THEN v ELSE coalesce(low, 0) END AS d FROM q) GROUP BY ALL")
def w15_occupancy_decode(t: Tables) -> DataFrame:
    entries = t.expr()
    library = entries.groupBy("cell").agg(F.round(F.sum("v"), 9).alias("library"))
    rows = ranks.occupancy_decoded(entries.join(library, "cell"), 1.3)
    return rows.groupBy("state", "gene").agg(F.count_if(F.col("decoded") > 0).alias("active"), r(F.sum("decoded")).alias("total"))


@query(f"WITH {EXPR}, t AS (SELECT cell, rank() OVER (PARTITION BY state ORDER BY v) + (count(*) OVER (PARTITION BY state, v) - 1) / 2.0 AS rb FROM expr WHERE gene = 33), q AS MATERIALIZED (SELECT cell, state, gene, v, rank() OVER (PARTITION BY state, gene ORDER BY v) + (count(*) OVER (PARTITION BY state, gene, v) - 1) / 2.0 AS ra, row_number() OVER (PARTITION BY state, gene ORDER BY v, cell) AS k0 FROM expr), k AS MATERIALIZED (SELECT q.*, row_number() OVER (PARTITION BY state, gene ORDER BY 0.6 * ra + 0.4 * rb, cell) AS k1 FROM q JOIN t USING (cell)) SELECT a.cell, a.gene, round(b.v, 6) + 0.0 AS restored FROM k a JOIN k b ON a.state = b.state AND a.gene = b.gene AND a.k1 = b.k0")
def w18_copula_restore(t: Tables) -> DataFrame:
    entries = t.expr()
    template = entries.where("gene = 33").select("cell", F.col("v").alias("w"))
    rows = entries.join(template, "cell")
    return ranks.copula_restored(rows, ["state", "gene"], "v", "w", 0.4, "cell").select("cell", "gene", r("restored").alias("restored"))


@query(f"WITH {EXPR}, k AS (SELECT *, row_number() OVER (PARTITION BY state, gene, stage ORDER BY v, cell) AS k FROM expr) SELECT a.cell, a.gene, round(b.v, 6) + 0.0 AS donor FROM k a JOIN k b ON a.state = b.state AND a.gene = b.gene AND a.k = b.k AND a.stage = 0 AND b.stage = 1")
def w19_rank_rebuild(t: Tables) -> DataFrame:
    return ranks.rank_rebuilt(t.expr()).select("cell", "gene", r("donor").alias("donor"))


@query("WITH m AS (SELECT event_type, user_id % 10 AS u, user_id % 3 AS g, CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY ALL), q AS (SELECT event_type, day, u, avg(m) AS m FROM m GROUP BY ALL), k AS (SELECT *, CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN -1.0 ELSE 1.0 END AS s FROM q), j AS (SELECT *, rank() OVER (PARTITION BY day, event_type ORDER BY m * sign(s)) + (count(*) OVER (PARTITION BY day, event_type, m * sign(s)) - 1) / 2.0 AS r FROM k), p AS (SELECT day, u, sum(r * abs(s)) / sum(abs(s)) AS m FROM j GROUP BY ALL) SELECT u, round(avg(m), 6) + 0.0 AS rank, count(*) AS cases FROM p GROUP BY 1")
def w20_mean_rank(t: Tables) -> DataFrame:
    e = t("events").withColumns({"u": F.col("user_id") % 10, "g": F.col("user_id") % 3, "day": F.to_date("ts")})
    q = e.groupBy("event_type", "u", "g", "day").agg(F.avg("value").alias("m")).groupBy("event_type", "day", "u").agg(F.avg("m").alias("m"))
    kinds = {x: 1.0 for x in ("purchase", "signup", "error", "login", "logout", "scroll", "search", "add_to_cart", "share")} | {"click": 2.0, "view": -1.0}
    return ranks.mean_rank(q, "day", "event_type", "u", "m", kinds).select("u", r("rank").alias("rank"), "cases")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS BIGINT) AS k FROM lineitem")
def w21_t4_stable_order(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", k.cast("long").alias("k"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events GROUP BY 1) SELECT event_id, CAST((a <= value)::INT + (b <= value)::INT + (c <= value)::INT AS BIGINT) AS block FROM events JOIN q USING (event_type)")
def w22_quartile_blocks(t: Tables) -> DataFrame:
    return ranks.quartile_blocks(t("events"), "value", ["event_type"]).select("event_id", "block")


@query("WITH q AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_partkey, l_linenumber, l_extendedprice) AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber, l_quantity) AS y FROM lineitem) SELECT l_suppkey, round(corr(x, y), 6) + 0.0 AS rho FROM q GROUP BY 1")
def w23_spearman_ordinal(t: Tables) -> DataFrame:
    tie = F.struct("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice"), F.col("l_quantity"))
    return ranks.spearman(t("lineitem").withColumn("tie", tie), ["l_suppkey"], "l_quantity", "l_extendedprice", False, "tie").select("l_suppkey", r("rho").alias("rho"))


@query("WITH q AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS y FROM lineitem) SELECT l_suppkey, round(corr(x, y), 6) + 0.0 AS rho FROM q GROUP BY 1")
def w24_spearman(t: Tables) -> DataFrame:
    return ranks.spearman(t("lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", r("rho").alias("rho"))


@query("WITH q AS (SELECT event_id, event_type, value - 50 AS e FROM events) SELECT event_id, round(sign(e) * (rank() OVER (PARTITION BY event_type ORDER BY abs(e)) + (count(*) OVER (PARTITION BY event_type, abs(e)) - 1) / 2.0) / count(*) OVER (PARTITION BY event_type), 8) + 0.0 AS target FROM q")
def w25_signed_rank(t: Tables) -> DataFrame:
    rows = t("events").withColumn("e", F.col("value") - 50)
    return ranks.signed_rank("e", ["event_type"], rows, "target").select("event_id", r("target", 8).alias("target"))


@query("WITH n AS (SELECT greatest(1, floor(count(*) * 0.002)) AS cap FROM part) SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= cap AS kept FROM orders, n")
def t1_capped_top_k(t: Tables) -> DataFrame:
    cap = F.broadcast(t("part").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.002)).alias("cap")))
    return ranks.top_k(t("orders").crossJoin(cap), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], F.col("cap")).select("o_orderpriority", "o_orderkey", "kept")


@query("WITH q AS (SELECT event_id, event_type, value - 50 AS e, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS lo FROM events) SELECT event_type, count(*) FILTER (hi <= 10) AS up, count(*) FILTER (lo <= 5) AS down, count(*) FILTER (hi <= 9 AND e > 0) > 0 AND count(*) FILTER (lo <= 5 AND e < 0) > 0 AS both_signs, round(sum(CASE WHEN hi <= 10 THEN e WHEN lo <= 5 THEN e ELSE 0 END), 4) + 0.0 AS support FROM q GROUP BY 1")
def t2_t3_signed_support(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type")
    q = t("events").withColumns({"e": F.col("value") - 50, "hi": F.row_number().over(w.orderBy(F.desc("value"), "event_id")), "lo": F.row_number().over(w.orderBy("value", "event_id"))})
    both = (F.count_if((F.col("hi") <= 9) & (F.col("e") > 0)) > 0) & (F.count_if((F.col("lo") <= 5) & (F.col("e") < 0)) > 0)
    return q.groupBy("event_type").agg(F.count_if(F.col("hi") <= 10).alias("up"), F.count_if(F.col("lo") <= 5).alias("down"), both.alias("both_signs"), r(F.sum(F.when((F.col("hi") <= 10) | (F.col("lo") <= 5), F.col("e")).otherwise(0.0)), 4).alias("support"))


@query("SELECT c_custkey, round(c_acctbal, 2) + 0.0 AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def t5_limit(t: Tables) -> DataFrame:
    return t("customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", r("c_acctbal", 2).alias("balance"))


@query("WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, user_id % 4 = 0 AS win FROM events), k AS (SELECT unnest([1, 5, 20, 100]) AS top) SELECT event_type, top, round(count(*) FILTER (win AND s.k <= top) / count(*) FILTER (win), 8) + 0.0 AS recall FROM s, k GROUP BY ALL")
def t6_top_k_recall(t: Tables) -> DataFrame:
    s = t("events").withColumns({"k": F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")), "win": F.col("user_id") % 4 == 0})
    tops = [1, 5, 20, 100]
    hits = s.groupBy("event_type").agg(F.count_if("win").alias("n"), *(F.count_if(F.col("win") & (F.col("k") <= top)).alias(f"h{top}") for top in tops))
    parts = F.explode(F.array(*(F.struct(F.lit(top).alias("top"), F.col(f"h{top}").alias("h")) for top in tops)))
    return hits.select("event_type", "n", parts.alias("p")).select("event_type", "p.top", r(F.col("p.h") / F.col("n"), 8).alias("recall"))


_SHARES = "s AS (SELECT event_type, count(*) AS c, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1)"


def _allocated(order: str, total: int, minimum: int = 0) -> str:
    return f"WITH {_SHARES}, e AS (SELECT event_type, c, round(share / (SELECT sum(share) FROM s) * ({total} - (SELECT count(*) FROM s) * {minimum}), 9) AS e FROM s), f AS (SELECT *, floor(e) AS f, round(e - floor(e), 9) AS r FROM e), o AS (SELECT *, row_number() OVER (ORDER BY r DESC, event_type {order}) AS o, {total} - sum(f + {minimum}) OVER () AS left_over FROM f) SELECT event_type, CAST(f + {minimum} + CASE WHEN o <= left_over THEN 1 ELSE 0 END AS BIGINT) AS n FROM o"


@query(_allocated("ASC", 997))
def m1_largest_remainder(t: Tables) -> DataFrame:
    return alloc.largest_remainder(mo.shares(t("events"), ["event_type"]).drop("n"), "event_type", 997).select("event_type", "n")


@query(_allocated("DESC", 998))
def m2_largest_remainder_descending(t: Tables) -> DataFrame:
    return alloc.largest_remainder(mo.shares(t("events"), ["event_type"]).drop("n"), "event_type", 998, descending=True).select("event_type", "n")


@query(_allocated("ASC", 103, 7))
def m3_minimum_quota(t: Tables) -> DataFrame:
    return alloc.largest_remainder(mo.shares(t("events"), ["event_type"]).drop("n"), "event_type", 103, minimum=7).select("event_type", "n")


@query("WITH a AS (" + _allocated("ASC", 9000) + "), p AS (SELECT event_type, count(*) FILTER (user_id % 3 < 2 OR event_type > 'm') AS available FROM events GROUP BY 1), q AS (SELECT *, least(n, available) AS q FROM a JOIN p USING (event_type)), w AS (SELECT *, available - q AS spare, coalesce(sum(available - q) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n - q) OVER () AS missing FROM q) SELECT event_type, CAST(q + least(spare, greatest(missing - before, 0)) AS BIGINT) AS final FROM w")
def m4_availability_clipped(t: Tables) -> DataFrame:
    events = t("events")
    quota = alloc.largest_remainder(mo.shares(events, ["event_type"]).drop("n"), "event_type", 9000).select("event_type", "n")
    pool = events.groupBy("event_type").agg(F.count_if((F.col("user_id") % 3 < 2) | (F.col("event_type") > "m")).alias("available"))
    return alloc.clipped_to_pool(quota.join(pool, "event_type"), "event_type").select("event_type", "final")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('5:' || event_id), event_id) AS k FROM events) WHERE k <= 40")
def m5_stratified_sample(t: Tables) -> DataFrame:
    return alloc.stratified(t("events"), ["event_type"], "event_id", 40, 5).select("event_type", "event_id")


@query("SELECT o_orderpriority, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('6:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 12")
def m6_two_key_sample(t: Tables) -> DataFrame:
    return alloc.stratified(t("orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 12, 6).select("o_orderpriority", "o_orderstatus", "o_orderkey")


@query("WITH d AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('8:' || vec_id), vec_id) AS o, count(*) OVER (PARTITION BY label) AS n FROM embeddings), q AS (SELECT *, 120 + label AS quota FROM d), c AS (SELECT label, vec_id, CAST(quota // n AS BIGINT) + CASE WHEN o <= quota % n THEN 1 ELSE 0 END AS c FROM q) SELECT label, vec_id, c AS copies FROM c WHERE c > 0")
def m7_m8_balanced_donors(t: Tables) -> DataFrame:
    donors = t("embeddings").select("label", "vec_id")
    quota = donors.select("label").distinct().withColumn("quota", F.col("label") + 120)
    return alloc.with_copies(donors, ["label"], "vec_id", quota, 8).groupBy("label", "vec_id").agg(F.count("*").alias("copies"))


@query("WITH c AS (SELECT event_type, event_id, value, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c, sum(value) OVER (PARTITION BY event_type) AS s FROM events), q AS (SELECT event_type, event_id, least(greatest(floor(c / s * 50 + 0.5), 0), 50) - least(greatest(floor((c - value) / s * 50 + 0.5), 0), 50) AS n FROM c) SELECT event_type, event_id, CAST(n AS BIGINT) AS copies FROM q WHERE n > 0")
def m9_m10_systematic(t: Tables) -> DataFrame:
    rows = ranks.systematic(t("events"), ["event_type"], "value", ["event_id"], 50)
    return rows.where("copies > 0").select("event_type", "event_id", F.col("copies").cast("long").alias("copies"))


@query("WITH k AS (SELECT event_type, event_id, user_id % 2 AS side, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY md5('11:' || event_id), event_id) AS k FROM events) SELECT event_type, side, event_id FROM k WHERE k <= CASE WHEN side = 0 THEN 30 ELSE 10 END")
def m11_two_parent_mixture(t: Tables) -> DataFrame:
    rows = t("events").withColumn("side", F.col("user_id") % 2)
    return alloc.stratified(rows, ["event_type", "side"], "event_id", F.when(F.col("side") == 0, 30).otherwise(10), 11).select("event_type", "side", "event_id")


_UNIFORM = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(f"WITH c AS (SELECT label, vec_id, sum(1 + vec_id % 3) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS upto FROM embeddings), t AS (SELECT label, max(upto) AS total FROM c GROUP BY 1), d AS (SELECT label, k, {_UNIFORM.format("'12:' || label || ':' || k")} * total AS pos FROM t, range(1, 51) r(k)), h AS (SELECT d.label, k, arg_min(vec_id, upto) AS vec_id FROM d JOIN c ON c.label = d.label AND upto > pos GROUP BY 1, 2) SELECT label, vec_id, count(*) AS times FROM h GROUP BY 1, 2")
def m12_weighted_bootstrap(t: Tables) -> DataFrame:
    rows = t("embeddings").withColumn("w", 1 + F.col("vec_id") % 3)
    return alloc.weighted_draws(rows, ["label"], "vec_id", "w", 50, 12)


_PAIRED = "p AS (SELECT s_nationkey AS nation, l_suppkey AS unit, avg(l_extendedprice) FILTER (l_returnflag = 'R') - avg(l_extendedprice) FILTER (l_returnflag = 'N') AS delta FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL HAVING delta IS NOT NULL)"


@query(f"WITH {_PAIRED}, v AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY nation) AS n FROM p), d AS (SELECT nation, rd, CAST(floor({_UNIFORM.format("'14:' || nation || ':' || rd || ':' || i")} * n) AS BIGINT) AS i FROM v, range(1, 41) g(rd)), m AS (SELECT nation, rd, avg(delta) AS m FROM d JOIN v USING (nation, i) GROUP BY ALL) SELECT nation, round(quantile_cont(m, 0.025), 4) + 0.0 AS low, round(quantile_cont(m, 0.975), 4) + 0.0 AS high FROM m GROUP BY 1")
def m14_paired_bootstrap(t: Tables) -> DataFrame:
    """The interval of a mean difference: differences are taken within suppliers, and suppliers of a nation drawn again."""
    of = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    supplier = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    units = t("lineitem").groupBy("l_suppkey").agg((of("R") - of("N")).alias("delta")).where("delta is not null").join(supplier, "l_suppkey")
    means = alloc.bootstrap_means(units, ["nation"], "delta", ["l_suppkey"], 40, 14)
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy("nation").agg(q.alias("q")).select("nation", r(F.col("q")[0], 4).alias("low"), r(F.col("q")[1], 4).alias("high"))


_RESAMPLED = f"WITH {EXPR}, k AS (SELECT cell, state, stage, row_number() OVER (PARTITION BY state, stage ORDER BY cell) - 1 AS i, count(*) OVER (PARTITION BY state, stage) AS n FROM cells), d AS (SELECT state, stage, rd, CAST(floor({_UNIFORM.format("'13:' || state || ':' || stage || ':' || rd || ':' || i")} * n) AS BIGINT) AS i FROM k, range(1, 9) g(rd)), c AS (SELECT d.rd, k.cell, state, stage, count(*) AS times FROM d JOIN k USING (state, stage, i) GROUP BY ALL UNION ALL SELECT 0, cell, state, stage, 1 FROM k)"


@query(_RESAMPLED + ", m AS (SELECT rd, c.state, c.stage, gene, sum(v * times) / sum(times) AS m FROM c JOIN expr USING (cell) GROUP BY ALL), p AS (SELECT a.rd, a.state AS a, b.state + 3 AS b, round(sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 9) AS s FROM m a JOIN m b ON a.gene = b.gene AND a.rd = b.rd AND a.stage = 0 AND b.stage = 1 GROUP BY ALL), k2 AS (SELECT *, row_number() OVER (PARTITION BY rd, a ORDER BY s DESC, b) AS ra, row_number() OVER (PARTITION BY rd, b ORDER BY s DESC, a) AS rb FROM p), e AS (SELECT rd, a, b FROM k2 WHERE ra = 1 AND rb = 1) SELECT x.a, x.b, round(count(y.rd) / 8.0, 6) + 0.0 AS recovered FROM (SELECT * FROM e WHERE rd = 0) x LEFT JOIN (SELECT * FROM e WHERE rd > 0) y ON y.a = x.a AND y.b = x.b GROUP BY 1, 2")
def m13_crosswalk_stability(t: Tables) -> DataFrame:
    """How often each mutual pair of states of both stages comes back when cells are drawn again within state and stage."""
    cells = t.cells().select("cell", "state", "stage").withColumn("one", F.lit(1))
    times = alloc.bootstrap_times(cells, ["state", "stage"], "cell", 8, 13).unionByName(cells.select("state", "stage", "cell", F.lit(0).alias("round"), F.lit(1).cast("long").alias("times")))
    e = t.expr().select("cell", "gene", "v")
    m = times.join(e, "cell").groupBy("round", "state", "stage", "gene").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    a, b = (m.where(F.col("stage") == s).select("round", F.col("state").alias(n), "gene", F.col("m").alias(f"m{n}")) for s, n in ((0, "a"), (1, "b")))
    s = F.round(F.sum(F.col("ma") * F.col("mb")) / F.sqrt(F.sum(F.col("ma") * F.col("ma")) * F.sum(F.col("mb") * F.col("mb"))), 9)
    p = a.join(b, ["round", "gene"]).groupBy("round", "a", "b").agg(s.alias("s")).withColumn("b", F.col("b") + 3)
    best = lambda side, other: F.row_number().over(Window.partitionBy("round", side).orderBy(F.desc("s"), other))
    edges = p.withColumns({"ra": best("a", "b"), "rb": best("b", "a")}).where("ra = 1 and rb = 1").select("round", "a", "b")
    again = edges.where("round > 0").groupBy("a", "b").agg(F.count("*").alias("n"))
    return edges.where("round = 0").join(again, ["a", "b"], "left").select("a", "b", r(F.coalesce("n", F.lit(0)) / 8).alias("recovered"))


@query("WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('15:' || vec_id), vec_id) AS o, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, CASE WHEN o * 2 <= n THEN 'a' ELSE 'b' END AS half FROM k")
def m15_random_halves(t: Tables) -> DataFrame:
    return alloc.halves(t("embeddings"), "vec_id", 15, ["label"]).select("vec_id", "half")


@query("WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS o FROM events), b AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY md5('16:' || event_id), event_id) AS o FROM events) SELECT event_id, round(value, 6) + 0.0 AS permuted FROM a JOIN b USING (event_type, o)")
def m16_within_label_shuffle(t: Tables) -> DataFrame:
    return alloc.shuffled(t("events"), ["event_type"], "event_id", "value", 16).select("event_id", r("permuted").alias("permuted"))


@query("WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('17:' || vec_id), vec_id) AS o, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT label, vec_id FROM k WHERE o <= greatest(10, floor(n * 0.1))")
def m17_working_copy(t: Tables) -> DataFrame:
    e = t("embeddings").withColumn("n", F.count("*").over(Window.partitionBy("label")))
    return alloc.stratified(e, ["label"], "vec_id", F.greatest(F.lit(10), F.floor(F.col("n") * 0.1)), 17).select("label", "vec_id")


@query("WITH g AS (SELECT DISTINCT p_type FROM part), k AS (SELECT p_type, row_number() OVER (ORDER BY md5('18:' || p_type), p_type) AS o, count(*) OVER () AS n FROM g) SELECT p_type, o <= ceil(0.25 * n) AS test FROM k")
def m18_group_split(t: Tables) -> DataFrame:
    groups = t("part").select("p_type").distinct()
    n = groups.agg(F.count("*").alias("n"))
    rows = alloc.stratified(groups.withColumn("one", F.lit(1)), ["one"], "p_type", F.lit(1 << 30), 18)
    return rows.crossJoin(F.broadcast(n)).select("p_type", (F.col("draw") <= F.ceil(0.25 * F.col("n"))).alias("test"))


@query(f"WITH {CELLS}, g AS (SELECT DISTINCT state FROM cells), n AS (SELECT state, count(*) AS c FROM cells GROUP BY 1) SELECT g.state AS held_out, CAST(sum(c) AS BIGINT) AS n_train FROM g JOIN n ON n.state <> g.state GROUP BY 1")
def m19_leave_one_group_out(t: Tables) -> DataFrame:
    n = t.cells().groupBy("state").agg(F.count("*").alias("c"))
    whole = n.agg(F.sum("c").alias("s"))
    return n.crossJoin(F.broadcast(whole)).select(F.col("state").alias("held_out"), (F.col("s") - F.col("c")).alias("n_train"))
