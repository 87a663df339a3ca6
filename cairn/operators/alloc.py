"""Integer allocation and reproducible sampling. Random order is the order of md5(seed:id), the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(seed: int | str, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def largest_remainder(shares: DataFrame, key: str, total: int, descending: bool = False, minimum: int = 0, share: str = "share") -> DataFrame:
    """Whole numbers that sum to total: floors, then one more for the largest fractions; ties by name, up or down.

    With a minimum every key gets so many first, and the rest is shared out.
    """
    size = shares.agg(F.count("*").alias("_k"), F.sum(share).alias("_s"))
    rows = shares.crossJoin(F.broadcast(size))
    exact = F.col(share) / F.col("_s") * (F.lit(total) - F.col("_k") * minimum)
    rows = rows.withColumn("_e", F.round(exact, 9)).withColumns({"_f": F.floor("_e").cast("long")}).withColumn("_r", F.round(F.col("_e") - F.col("_f"), 9))
    left = rows.agg((F.lit(total) - F.sum(F.col("_f") + minimum)).alias("_left"))
    name = F.desc(key) if descending else F.asc(key)
    ranked = rows.withColumn("_o", F.row_number().over(Window.orderBy(F.desc("_r"), name)))  # a row for each key: states are few
    out = ranked.crossJoin(F.broadcast(left))
    return out.withColumn("n", F.col("_f") + minimum + F.when(F.col("_o") <= F.col("_left"), 1).otherwise(0)).drop("_k", "_s", "_e", "_f", "_r", "_o", "_left")


def clipped_to_pool(quota: DataFrame, key: str, quota_col: str = "n", pool: str = "available") -> DataFrame:
    """Quotas cut to what is available; what is missing goes, in order of name, to keys that have some left."""
    rows = quota.withColumn("_q", F.least(quota_col, pool)).withColumn("_spare", F.col(pool) - F.col("_q"))
    missing = rows.agg(F.sum(F.col(quota_col) - F.col("_q")).alias("_missing"))
    before = F.coalesce(F.sum("_spare").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).crossJoin(F.broadcast(missing))
    more = F.least("_spare", F.greatest(F.col("_missing") - F.col("_before"), F.lit(0)))
    return rows.withColumn("final", F.col("_q") + more).drop("_q", "_spare", "_missing", "_before")


def stratified(df: DataFrame, by: list[str], ident: str, k: Column | int, seed: int) -> DataFrame:
    """The first k of each stratum in random order; ``draw`` is the place."""
    rows = df.withColumn("_h", hash_order(seed, ident))
    rows = rows.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy("_h", ident)))
    return rows.where(F.col("draw") <= k).drop("_h")


def with_copies(df: DataFrame, by: list[str], ident: str, quota: DataFrame, seed: int) -> DataFrame:
    """Donors used evenly: each floor(q / n) times, the first of a random order once more; ``copy`` numbers them."""
    rows = df.withColumn("_h", hash_order(seed, ident))
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"_o": F.row_number().over(w.orderBy("_h", ident)), "_n": F.count("*").over(w)}).join(quota, by)
    copies = F.floor(F.col("quota") / F.col("_n")) + F.when(F.col("_o") <= F.col("quota") % F.col("_n"), 1).otherwise(0)
    return rows.withColumn("_c", copies.cast("int")).where("_c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_h", "_o", "_n", "_c", "quota")


def halves(df: DataFrame, ident: str, seed: int, by: list[str]) -> DataFrame:
    """Two disjoint random halves of each group."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_h", hash_order(seed, ident))
    rows = rows.withColumns({"_o": F.row_number().over(w.orderBy("_h", ident)), "_n": F.count("*").over(w)})
    return rows.withColumn("half", F.when(F.col("_o") * 2 <= F.col("_n"), "a").otherwise("b")).drop("_h", "_o", "_n")


def shuffled(df: DataFrame, by: list[str], ident: str, value: str, seed: int) -> DataFrame:
    """Values permuted within groups."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_o", F.row_number().over(w.orderBy(ident)))
    values = df.withColumn("_h", hash_order(seed, ident)).select(*by, F.col(value).alias("permuted"), F.row_number().over(w.orderBy("_h", ident)).alias("_o"))
    return rows.join(values, [*by, "_o"]).drop("_o")


def uniform(seed: int | str, *ids: Column) -> Column:
    """A number in 0 to 1 from the first 13 hex digits of md5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in ids)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def bootstrap_times(df: DataFrame, by: list[str], ident: str, rounds: int, seed: int) -> DataFrame:
    """How often each row is drawn in each round, as many times with replacement as its group has rows: by, ident, round, times."""
    w = Window.partitionBy(*by)
    rows = df.select(*by, ident, (F.row_number().over(w.orderBy(ident)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    draws = rows.select(*by, "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    place = F.floor(uniform(seed, *(F.col(b) for b in by), F.col("round"), F.col("_i")) * F.col("_n")).cast("int")
    # Counted before they meet the rows: at most as many as there are rows in each round.
    times = draws.select(*by, "round", place.alias("_i")).groupBy(*by, "round", "_i").agg(F.count("*").alias("times"))
    return times.join(rows.select(*by, "_i", ident), [*by, "_i"]).select(*by, ident, "round", "times")


def bootstrap_means(df: DataFrame, by: list[str], value: str, order: list[str], rounds: int, seed: int) -> DataFrame:
    """Bootstrap of group means: rounds draws with replacement, each draw an index from a hash. Groups are small."""
    w = Window.partitionBy(*by)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    draws = rows.select(*by, "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    keys = [F.col(b) for b in by]
    draws = draws.withColumn("_p", F.floor(uniform(seed, *keys, F.col("round"), F.col("_i")) * F.col("_n")).cast("int"))
    picked = draws.select(*by, "round", F.col("_p").alias("_i")).join(rows.select(*by, "_i", value), [*by, "_i"])
    return picked.groupBy(*by, "round").agg(F.avg(value).alias("mean"))


def weighted_draws(df: DataFrame, by: list[str], ident: str, weight: str, draws: int, seed: int) -> DataFrame:
    """Rows drawn with replacement, by their weight: ``draws`` of each group, as the number of times that each row is drawn.

    A draw is a place on the group's running sum of weights, from a hash; it takes the row whose stretch it falls in.
    """
    w = Window.partitionBy(*by)
    rows = df.select(*by, ident, F.col(weight).cast("double").alias("_w")).where("_w > 0")
    marks = rows.select(*by, F.col(ident).alias("_id"), F.sum("_w").over(w.orderBy(ident).rowsBetween(Window.unboundedPreceding, 0)).alias("_at"), F.lit(0).alias("_kind"))
    total = rows.groupBy(*by).agg(F.sum("_w").alias("_total")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    places = total.select(*by, F.lit(None).cast(dict(df.dtypes)[ident]).alias("_id"), (uniform(seed, *(F.col(b) for b in by), F.col("_k")) * F.col("_total")).alias("_at"), F.lit(1).alias("_kind"))
    taken = F.first("_id", ignorenulls=True).over(w.orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing))
    drawn = marks.unionByName(places).withColumn(ident, taken).where("_kind = 1")
    return drawn.groupBy(*by, ident).agg(F.count("*").alias("times"))
