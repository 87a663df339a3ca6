"""Joins with contracts: one-to-one, prioritised fallbacks, nearest centroids, crosswalks, grid ranges, neighbours."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .knn import finite, neighbours_among


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of checks: duplicate keys on either side, keys without a partner on either side, pairs."""
    n = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key, "full")
    return n.agg(
        F.count_if(F.col("_l") > 1).alias("duplicate_left"), F.count_if(F.col("_r") > 1).alias("duplicate_right"),
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("pairs"),
    )


def prioritised(left: DataFrame, right: DataFrame, keys: list[str], value: str, levels: list[list[str]], empty: str = "") -> DataFrame:
    """The value of the first level that has a row: a level names the keys that must agree, the others are empty there.

    Each level is one equi-join with the rows of right that are empty elsewhere; right holds one row for each combination.
    """
    out = left
    for i, level in enumerate(levels):
        rows = right
        for k in keys:
            rows = rows.where(F.col(k) != empty) if k in level else rows.where(F.col(k) == empty)
        rows = rows.select(*level, F.col(value).alias(f"_v{i}"))
        out = out.join(rows, level, "left") if level else out.crossJoin(F.broadcast(rows.limit(1)))
    found = [F.when(F.col(f"_v{i}").isNotNull(), i) for i in range(len(levels))]
    return out.withColumns({value: F.coalesce(*(F.col(f"_v{i}") for i in range(len(levels)))), "level": F.coalesce(*found)}).drop(*(f"_v{i}" for i in range(len(levels))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def nearest(rows: DataFrame, centres: DataFrame, x: str, name: str, centre: str, score, ident: str, largest_name: bool = False) -> DataFrame:
    """For each row the centre of the largest score; ties to the lowest name, or the largest.

    Centres travel as arrays of about ``CENTRES`` at a time, and each row keeps the best: of many centres one array after the
    other passes the rows, so what is broadcast is bounded whatever their number.
    """
    order = (lambda s: s) if largest_name else (lambda s: -s)
    out = rows
    for k, every in enumerate(portions(centres, name, F.struct(name, centre))):
        options = F.transform("_all", lambda c: F.struct(F.round(score(F.col(x), c[centre]), 9).alias("score"), order(c[name]).alias("_o"), c[name].alias(name)))
        best = F.array_max(options) if not k else F.array_max(F.array_append(options, F.col("_best")))
        out = out.crossJoin(every).withColumn("_best", best).drop("_all")
    return out.select(ident, F.col(f"_best.{name}").alias(f"nearest_{name}"), F.col("_best.score").alias("score"))


CENTRES = 2048


def portions(table: DataFrame, names: str | tuple, row: Column, column: str = "_all") -> list[DataFrame]:
    """A table as arrays of about ``CENTRES`` rows, dealt by a hash of ``names``: one-row tables, each to be broadcast."""
    parts = max(1, -(-table.count() // CENTRES))
    dealt = table.withColumn("_part", F.pmod(F.xxhash64(*([names] if isinstance(names, str) else names)), F.lit(parts)))
    return [F.broadcast(dealt.where(F.col("_part") == k).agg(F.collect_list(row).alias(column))) for k in range(parts)]


def crosswalk(pairs: DataFrame, a: str, b: str, score: str, least: float) -> DataFrame:
    """SHARED_EXACT where names are equal, MUTUAL where each is the other's best and the score is enough, else UNRESOLVED.

    ``pairs``: all pairs of the two vocabularies with their score; ties to the lower name.
    """
    ranked = pairs.withColumns({"_ra": F.row_number().over(Window.partitionBy(a).orderBy(F.desc(score), b)), "_rb": F.row_number().over(Window.partitionBy(b).orderBy(F.desc(score), a))})
    exact = F.max((F.col(a) == F.col(b)).cast("int"))
    hit = F.max(F.when(F.col(a) == F.col(b), F.col(b)))
    mutual = F.max(F.when((F.col("_ra") == 1) & (F.col("_rb") == 1) & (F.col(score) >= least), F.col(b)))
    rows = ranked.groupBy(a).agg(exact.alias("_e"), hit.alias("_h"), mutual.alias("_m"))
    status = F.when(F.col("_e") == 1, "SHARED_EXACT").when(F.col("_m").isNotNull(), "MUTUAL").otherwise("UNRESOLVED")
    return rows.select(a, F.when(F.col("_e") == 1, F.col("_h")).otherwise(F.col("_m")).alias("match"), status.alias("status"))


def in_range(points: DataFrame, radius: Column | float, by: list[str], ident: str = "cell", sources: DataFrame | None = None) -> DataFrame:
    """Pairs of points of a group within a distance, by a grid: a point visits the cells around its own.

    Rows grow with the points and their neighbours, not with the square of the points. ``radius`` is one number for each
    group. ``sources``: the points that visit, if not all.
    """
    radius = F.lit(radius) if isinstance(radius, float) else radius
    grid = [F.floor(F.col(c) / radius).cast("long").alias(f"_{c}") for c in "xyz"]
    home = points.select(*by, F.col(ident).alias("dst"), *(F.col(c).alias(f"{c}2") for c in "xyz"), *grid)
    steps = F.array(*(F.struct(*(F.lit(d).alias(n) for n, d in zip("abc", s, strict=True))) for s in itertools.product((-1, 0, 1), repeat=3)))
    visits = (points if sources is None else sources).select(*by, F.col(ident).alias("src"), *"xyz", radius.alias("_radius"), *grid, F.explode(steps).alias("_s"))
    visits = visits.select(*by, "src", *"xyz", "_radius", *((F.col(f"_{c}") + F.col(f"_s.{n}")).alias(f"_{c}") for c, n in zip("xyz", "abc", strict=True)))
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"{c}2"), 2) for c in "xyz"), F.lit(0.0)))
    return visits.join(home, [*by, "_x", "_y", "_z"]).withColumn("dist", d).where(F.col("dist") <= F.col("_radius")).select(*by, "src", "dst", "dist", "_radius")


def neighbours(points: DataFrame, k: int, by: list[str], keep_self: bool = False) -> DataFrame:
    """The k nearest of each point of a group, as ``neighbours_among`` finds them; with keep_self a point is its own first neighbour."""
    found = neighbours_among(points, points, k - 1 if keep_self else k, by)
    if keep_self:
        own = points.where(finite()).select(*by, F.col("cell").alias("src"), F.col("cell").alias("dst"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))
        found = own.unionByName(found.withColumn("rank", F.col("rank") + 1))
    return found


def bracketed(events: DataFrame, marks: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """For each event the last mark at or before it, by one window over both tables in order of time."""
    a = events.select(*by, time, F.lit(1).alias("_k"), F.struct(*events.columns).alias("_e"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("_v"))
    b = marks.select(*by, time, F.lit(0).alias("_k"), F.lit(None).cast(a.schema["_e"].dataType).alias("_e"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(time, "_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_k = 1")
    return rows.select("_e.*", value)
