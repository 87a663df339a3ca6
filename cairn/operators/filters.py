"""Filters and gates: text firewalls, support, quality and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def firewall(df: DataFrame, text: str, required: str, forbidden: str) -> DataFrame:
    """Rows whose text, in lower case, has the required pattern and not the forbidden one; a null text is no evidence."""
    low = F.lower(text)
    return df.where(F.col(text).isNotNull() & low.rlike(required) & ~low.rlike(forbidden))


def has_forbidden(text: Column, words: list[str]) -> Column:
    """Whether one of the words is among the tokens of a text, cut at ``+ ; , / |`` and blanks."""
    return F.coalesce(F.arrays_overlap(F.split(F.upper(text), "[+;,/ |]+"), F.array(*map(F.lit, words))), F.lit(False))


def called_cells(entries: DataFrame, least_sum: float, least_genes: int, marked: Column, most_share: float) -> DataFrame:
    rows = entries.groupBy("cell").agg(F.sum("v").alias("library"), F.count_if(F.col("v") > 0).alias("genes"), F.sum(F.when(marked, F.col("v"))).alias("part"))
    return rows.where((F.col("library") >= least_sum) & (F.col("genes") >= least_genes) & (F.col("part") / F.col("library") <= most_share))


def supported(df: DataFrame, group: str, side: str, sides: list, least: int) -> DataFrame:
    """Rows of groups that have at least so many rows on every side."""
    n = df.groupBy(group).agg(*(F.count_if(F.col(side) == s).alias(f"n{i}") for i, s in enumerate(sides)))
    good = n.where(" and ".join(f"n{i} >= {least}" for i in range(len(sides)))).select(group)
    return df.join(good, group, "left_semi")


def trusted(name: Column, prefixes: list[str], names: list[str], ratio: Column, most: float) -> Column:
    bad = name.isin(names) | (ratio > most)
    for p in prefixes:
        bad |= name.startswith(p)
    return ~bad


def finite_non_negative(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf")) & (v >= 0)


def variable_genes(entries: DataFrame, least_mean: float, n: int) -> DataFrame:
    """Genes of the largest variance over mean."""
    rows = entries.groupBy("gene").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).where(F.col("m") > least_mean)
    return rows.select("gene", (F.col("s") / F.col("m")).alias("dispersion")).orderBy(F.desc("dispersion"), "gene").limit(n)


def correlated_with(entries: DataFrame, gene: int) -> DataFrame:
    """Genes whose correlation with one gene is above the median of the non-zero ones.

    The gene's value travels with its cell by a join on the cell.
    """
    own = entries.where(F.col("gene") == gene).select("cell", F.col("v").alias("w"))
    rho = entries.where(F.col("gene") > gene).join(own, "cell").groupBy("gene").agg(F.corr("v", "w").alias("rho"))
    middle = rho.where("rho <> 0").agg(F.percentile(F.abs("rho"), F.lit(0.5)).alias("m"))
    return rho.crossJoin(F.broadcast(middle)).where(F.abs("rho") > F.col("m")).select("gene", "rho")
