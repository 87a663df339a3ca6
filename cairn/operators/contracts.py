"""Contracts as data: one row for each check, never an exception in the middle of a job."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import neighbours
from .lineage import settled
from .ranks import row_numbers


def set_difference(a: DataFrame, b: DataFrame, only_a: str, only_b: str) -> DataFrame:
    """Rows of either side that the other lacks, counted with multiplicity, in one aggregation over both."""
    rows = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_n").alias("_n"))
    return rows.agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias(only_a), F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias(only_b))


def matrix_contract(cells: DataFrame, width: int, least_cells: int, most_cells: int) -> DataFrame:
    """name, bad, passed of each check of an annotated matrix (cell, state, x)."""
    count = lambda f: F.sum(F.size(F.filter("x", f)))
    row = cells.agg(
        (F.count("*") - F.count_distinct("cell")).alias("unique_cells"), count(lambda v: F.isnan(v) | (F.abs(v) == float("inf"))).alias("finite"), count(lambda v: v < 0).alias("non_negative"),
        F.count_if(F.col("state").isNull()).alias("state_present"), F.count_if(F.size("x") != width).alias("width"), F.when(F.count("*").between(least_cells, most_cells), 0).otherwise(1).cast("long").alias("cell_range"),
    )
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("bad")) for c in row.columns))).alias("c")).select("c.*")
    return long.withColumn("passed", F.col("bad") == 0)


def bijection(df: DataFrame, by: list[str], k: str) -> DataFrame:
    """Whether k runs from 1 to the size of each group without repetition."""
    n = F.count("*")
    return df.groupBy(*by).agg(((F.count_distinct(k) == n) & (F.max(k) == n) & (F.min(k) == 1)).alias("bijection"))


def conserved(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    a = before.groupBy(key).agg(F.count("*").alias("before"))
    b = after.groupBy(key).agg(F.count("*").alias("after"))
    rows = a.join(b, key, "left").fillna(0, ["after"])
    return rows.withColumn("conserved", F.col("before") == F.col("after"))


def all_passed(checks: list[DataFrame]) -> DataFrame:
    """Checks of several contracts as one table."""
    return functools.reduce(DataFrame.unionByName, checks)


#: Fixed values of the ordered digest: base and modulus, so that products stay within 63 bits.
BASE, MODULUS = 1_000_003, 2_147_483_647


def text_hash(*columns: Column | str) -> Column:
    """28 bits of the MD5 of the columns' text, joined by bars; nulls are empty text."""
    text = F.concat_ws("|", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def power(exponent: Column) -> Column:
    """BASE to the exponent modulo MODULUS, bit by bit."""
    squares, b = [], BASE
    for _ in range(62):
        squares.append(b)
        b = b * b % MODULUS
    bit = lambda s, q: F.when(exponent.bitwiseAND(q["bit"]) != 0, s * q["b"] % MODULUS).otherwise(s)
    table = F.array(*(F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(v).cast("long").alias("b")) for i, v in enumerate(squares)))
    return F.aggregate(table, F.lit(1).cast("long"), bit)


def ordered_digest(df: DataFrame, order: list[str], columns: list, by: list[str] | None = None) -> DataFrame:
    """rows, digest of a table in an order: the polynomial of its rows' hashes at BASE, the first row the lowest power.

    Parts can be digested alone and put together (``joined_digest``), and the sum does not depend on partitions; two rows that
    change places, a changed value, a lost or a new row change it. ``by``: one digest for each group of a table whose
    column ``row`` numbers each group's rows from 0.
    """
    numbered = df if by is not None else row_numbers(df, order, "row")
    term = (text_hash(*columns) % MODULUS) * power(F.col("row")) % MODULUS
    total = F.coalesce(F.sum(term.cast("decimal(38,0)")), F.lit(0)) % MODULUS
    return numbered.groupBy(*(by or [])).agg(F.count("*").alias("rows"), total.cast("long").alias("digest"))


def joined_digest(first_rows: int, first: int, second: int) -> int:
    """The digest of one table followed by another."""
    return (first + second * pow(BASE, first_rows, MODULUS)) % MODULUS


def neighbour_fingerprint(points: DataFrame, k: int, by: list[str]) -> DataFrame:
    """rows, digest of the neighbour table: each cell's k nearest with their ranks, whatever order rows stand in."""
    near = neighbours(points, k, by)
    total = F.coalesce(F.sum(text_hash("src", "dst", "rank").cast("decimal(38,0)")), F.lit(0)) % MODULUS
    return near.agg(F.count("*").alias("rows"), total.cast("long").alias("digest"))


def rewrite_invariants(before: DataFrame, after: DataFrame, order: list[str], k: int, by: list[str]) -> DataFrame:
    """name, before, after, kept of what a rewrite of a matrix (cell, state, x, and places as x1, y1, z1) must keep: the number of
    rows, cells in order, states in order, expression in order, and neighbours."""
    def row(df: DataFrame) -> dict[str, int]:
        named = df.select(*order, "cell", "state", F.array_join(F.transform("x", lambda v: F.coalesce(v.cast("string"), F.lit(""))), ",").alias("text"))
        numbered = settled(row_numbers(named, order, "row").withColumn("one", F.lit(1)))
        out = {name: ordered_digest(numbered, order, [c], ["one"]).first() for name, c in (("cells", "cell"), ("states", "state"), ("expression", "text"))}
        near = neighbour_fingerprint(df.select("cell", *by, *(F.col(f"{c}1").alias(c) for c in "xyz")), k, by).first()
        return {"rows": out["cells"]["rows"] if out["cells"] else 0} | {n: r["digest"] if r else 0 for n, r in out.items()} | {"neighbours": near["digest"]}

    a, b = row(before), row(after)
    return before.sparkSession.createDataFrame([(n, a[n], b[n], a[n] == b[n]) for n in a], "name string, before long, after long, kept boolean")
