"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Every step deals rows out by node and keeps only aggregates of a node in one place; edges of a hub are split by the skewed
join handling. Lineage is cut by writing each round to the shared folder. Rounds are about the logarithm of the longest
path; edges within tasks should already be stars.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_at


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node with an edge to another the smallest node of its component. Nodes are of one ordered type."""
    pairs = edges.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark = edges.sparkSession
    pairs, path = stored_at(pairs, "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = stored_at(large.where(F.col("u") != F.col("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after, after_path = stored_at(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        for old in (path, large_path):
            discard(spark, old)
        path = after_path
        # Done when all edges are stars with their least node at the centre: no node is both an end and a centre, or an end twice.
        # One aggregation over the nodes tells, so that a round plans no further join and the driver holds less.
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("end"), F.lit(0).alias("centre"))
        centres = after.select(F.col("v").alias("node"), F.lit(0).alias("end"), F.lit(1).alias("centre"))
        held = ends.unionByName(centres).groupBy("node").agg(F.sum("end").alias("end"), F.max("centre").alias("centre"))
        if not held.where("end + centre > 1").limit(1).count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        pairs = after


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges held in memory: each node that isn't the least of its component, and that least node."""
    if not len(a):
        return a[:0], b[:0]
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
