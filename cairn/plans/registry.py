"""Registration of queries, and the driver tables in the shapes that operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.matrix import to_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The same shapes in SQL: cells, and their entries with non-negative values.
CELLS = "cells AS (SELECT vec_id AS cell, label AS state, vec_id % 2 AS stage, embedding AS e FROM embeddings)"
EXPR = CELLS + ", expr AS (SELECT cell, state, stage, g AS gene, greatest(CAST(e[g] AS DOUBLE), 0) AS v FROM cells, range(1, 65) r(g))"
POINTS = "points AS (SELECT vec_id AS cell, label AS state, vec_id % 2 AS stage, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


class Tables:
    """The driver's tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cells(self) -> DataFrame:
        """cell, state, stage, x: a cell's values, never negative."""
        x = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
        return self("embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("state"), (F.col("vec_id") % 2).alias("stage"), x.alias("x"))

    def expr(self) -> DataFrame:
        return to_long(self.cells())

    def points(self) -> DataFrame:
        at = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
        return self("embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("state"), (F.col("vec_id") % 2).alias("stage"), *at)


def query(sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under its name, with the SQL that it equals."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero: what results carry of doubles."""
    return F.round(value, digits) + F.lit(0.0)
