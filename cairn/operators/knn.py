"""Exact nearest neighbours in three dimensions, by leaves of k-d trees and an exchange across their borders.

1. Each group of many points gets a tree of median cuts from a sample of its points, so that a leaf holds about ``LEAF``
   points wherever they are dense or thin. The trees are small (a cut for each leaf) and go to all tasks.
2. Sources meet the points of their own leaf. The distance of the last neighbour found there is the radius of a ball.
3. A source whose ball crosses the border of its leaf visits the leaves that the ball touches, and no others.
4. What the leaves give is ranked by source.

Rows grow with sources, whatever the density: a source is sent to its leaf and to those at its border, and each gives it its
nearest alone. Points of equal place are one place with the lowest names, one more than are asked for. A leaf with many
sources is dealt out in parts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import settled

LEAF = 512
SAMPLED = 16
"""Sampled points a leaf."""
PART = 4096
"""Sources of a leaf that meet its points in one task."""
TIE = 2e-9
"""Distances that round alike are ties; balls are wider by what rounding may take."""
AXES = ["x", "y", "z"]


class Tree:
    """Cuts of space: what is below ``value`` along ``dim`` is left. A child below 0 is a leaf, the number ~child."""

    def __init__(self, dim, value, left, right):
        self.dim, self.left, self.right = (np.asarray(v, np.int64) for v in (dim, left, right))
        self.value = np.asarray(value, float)

    @staticmethod
    def of(sample: np.ndarray, most: int) -> Tree:
        """Cuts at medians of the widest dimension until no more than ``most`` of the sample are together."""
        dim, value, left, right, leaves = [], [], [], [], 0
        waiting = [(sample, None)]
        while waiting:
            points, place = waiting.pop()
            spans = points.max(0) - points.min(0) if len(points) else np.zeros(3)
            if len(points) <= most or spans.max() <= 0:
                node, leaves = ~leaves, leaves + 1
            else:
                node, d = len(dim), int(spans.argmax())
                x = np.sort(points[:, d])
                cut = x[len(x) // 2] if x[len(x) // 2] > x[0] else x[np.searchsorted(x, x[0], "right")]
                dim.append(d)
                value.append(cut)
                left.append(0)
                right.append(0)
                below = points[:, d] < cut
                waiting += [(points[below], (left, node)), (points[~below], (right, node))]
            if place:
                place[0][place[1]] = node
        return Tree(dim, value, left, right)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), 0 if len(self.dim) else ~0)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            below = points[inner, self.dim[node]] < self.value[node]
            at[inner] = np.where(below, self.left[node], self.right[node])
        return ~at

    def touched(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which points' balls touch which leaves."""
        who, leaves = [], []
        waiting = [(0 if len(self.dim) else ~0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if node < 0:
                who.append(rows)
                leaves.append(np.full(len(rows), ~node))
                continue
            x, cut = points[rows, self.dim[node]], self.value[node]
            waiting.append((int(self.left[node]), rows[x - radius[rows] < cut]))
            waiting.append((int(self.right[node]), rows[x + radius[rows] >= cut]))
        return np.concatenate(who or [np.zeros(0, int)]), np.concatenate(leaves or [np.zeros(0, int)])


def finite() -> Column:
    return functools.reduce(lambda a, b: a & b, (F.abs(F.col(c)) < F.lit(float("inf")) for c in AXES))


def _names(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)


def _places(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy().astype(float) for c in AXES], 1)


def search(sources: pa.Table, points: pa.Table, others: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each source the nearest points that aren't itself: row of the source, row of the point, distance; and for each
    source how far its neighbours may be (infinite, if there are too few points)."""
    names, place = _names(points["cell"]), _places(points)
    order = np.argsort(names, kind="stable")  # ties go to the lower name
    names, place = names[order], place[order]
    mine, at, k = _names(sources["cell"]), _places(sources), min(others, len(names))
    if not k:
        none = np.zeros(0, int)
        return none, none, np.zeros(0), np.full(len(mine), np.inf if others else 0.0)
    own = np.minimum(np.searchsorted(names, mine), max(len(names) - 1, 0))
    found, reach = [], np.full(len(mine), np.inf)
    step = max(1, (1 << 21) // max(len(names), 1))
    for lo in range(0, len(mine), step):
        part = at[lo : lo + step]
        square = np.zeros((len(part), len(names)))
        for c in range(3):
            square += (part[:, c : c + 1] - place[:, c]) ** 2
        dist = np.sqrt(square)
        rows, here = np.arange(len(part)), own[lo : lo + step]
        dist[rows, here] = np.where(names[here] == mine[lo : lo + step], np.inf, dist[rows, here])
        rounded = dist.round(9)
        if 8 * k < len(names):  # all that isn't beyond the last rank, ties included, then their order
            last = np.partition(rounded, k - 1, axis=1)[:, k - 1]
            who, what = np.nonzero(rounded <= last[:, None])
            by = np.lexsort((what, rounded[who, what], who))
            who, what = who[by], what[by]
            rank = np.arange(len(who)) - np.searchsorted(who, np.arange(len(part)))[who]
            who, what = who[rank < k], what[rank < k]
        else:
            what = np.argsort(rounded, axis=1, kind="stable")[:, :k].ravel()
            who = np.repeat(rows, k)
        d = dist[who, what]
        some = np.isfinite(d)
        who, what, d = who[some], what[some], d[some]
        full = np.bincount(who, minlength=len(part)) >= others
        furthest = np.zeros(len(part))
        np.maximum.at(furthest, who, d)
        reach[lo : lo + step] = np.where(full, furthest + TIE, np.inf)
        found.append((who + lo, order[what], d))
    src, dst, d = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return src, dst, d, reach


def _met(sources: DataFrame, points: DataFrame, by: list[str], task, schema: str) -> DataFrame:
    """Sources and points of each leaf together, sources in parts."""
    key = [*by, "leaf"]
    parts = sources.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    a = sources.join(parts, key).withColumn("part", F.pmod(F.xxhash64("cell"), F.col("parts")).cast("int")).drop("parts")
    points = points.select(*(F.col(c).alias(c) for c in points.columns))  # columns of its own, where both are of one table
    b = points.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = [*key, "part"]
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(task, schema)


def _trees(points: DataFrame, by: list[str], leaf: int) -> dict[tuple, Tree]:
    """Of each group with points for several leaves its tree."""
    large = points.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > 3 * leaf // 2)
    large = settled(large.select(*by))
    if large.isEmpty():
        return {}
    share = int(min(1.0, SAMPLED / leaf) * (1 << 30))
    sample = points.where(F.pmod(F.xxhash64("cell"), F.lit(1 << 30)) < share).join(large, by).select(*by, *AXES)
    kinds = dict(points.dtypes)

    def build(key, table):
        tree = Tree.of(_places(table), 3 * SAMPLED // 2)
        return pa.table({c: pa.array([k.as_py()], k.type) for c, k in zip(by, key, strict=True)} | {c: pa.array([getattr(tree, c).tolist()], t) for c, t in _CUTS.items()})

    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["dim array<long>", "value array<double>", "left array<long>", "right array<long>"])
    return {tuple(r[c] for c in by): Tree(r["dim"], r["value"], r["left"], r["right"]) for r in sample.groupBy(*by).applyInArrow(build, schema).toLocalIterator()}


_CUTS = {"dim": pa.list_(pa.int64()), "value": pa.list_(pa.float64()), "left": pa.list_(pa.int64()), "right": pa.list_(pa.int64())}


def _placed(rows: DataFrame, by: list[str], trees: dict[tuple, Tree]) -> DataFrame:
    """With the leaf that each row is in."""
    if not trees:
        return rows.withColumn("leaf", F.lit(0))
    kinds = dict(rows.dtypes)

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups, leaf, at = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True)), np.zeros(batch.num_rows, np.int32), _places(table)
            for group in set(groups) & trees.keys():
                mine = np.array([g == group for g in groups])
                leaf[mine] = trees[group].leaf_of(at[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return rows.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", leaf int")


def neighbours_among(sources: DataFrame, points: DataFrame, others: int, by: list[str], leaf: int | None = None) -> DataFrame:
    """For each source the ``others`` nearest points of its group, itself left out, however far, ties (at nine digits) to the
    lower name: by, src, dst, dist and ``rank`` from 1.

    What has no finite place or a null group has no neighbours and is no one's. ``leaf``: points of a leaf, about."""
    leaf = leaf or max(LEAF, 8 * (others + 1))
    whole = functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by), finite() & F.col("cell").isNotNull())
    columns = [*by, "cell", *AXES]
    alike = Window.partitionBy(*by, *AXES).orderBy("cell")
    kinds = dict(points.dtypes)
    points = settled(points.where(whole).select(*columns).withColumn("_k", F.row_number().over(alike)).where(F.col("_k") <= others + 1).drop("_k"))
    trees = _trees(points, by, leaf)
    points = _placed(points, by, trees)
    sources = _placed(sources.where(whole).select(*columns), by, trees)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    schema = f"{keys}, src {kinds['cell']}, dst {kinds['cell']}, dist double, leaf int, x double, y double, z double, radius double"

    def rows(key, s: pa.Table, p: pa.Table, src, dst, dist, visits=None) -> pa.Table:
        """What was found, and visits: rows of a leaf, a place and a radius."""
        none, n = np.zeros(0, int), len(src)
        who, leaves, radius = visits or (none, none, np.zeros(0))
        m = len(who)
        named = {c: pa.array([k.as_py()] * (n + m), k.type) for c, k in zip(by, key, strict=False)}
        nulls = lambda k, kind: pa.nulls(k, kind)
        kind = s["cell"].type
        columns = {
            "src": s["cell"].combine_chunks().take(pa.array(np.concatenate([src, who]))), "dst": pa.concat_arrays([p["cell"].combine_chunks().cast(kind).take(pa.array(dst)), nulls(m, kind)]),
            "dist": pa.concat_arrays([pa.array(dist, pa.float64()), nulls(m, pa.float64())]), "leaf": pa.concat_arrays([nulls(n, pa.int32()), pa.array(leaves, pa.int32())]),
        }
        columns |= {c: pa.concat_arrays([nulls(n, pa.float64()), s[c].combine_chunks().cast(pa.float64()).take(pa.array(who))]) for c in AXES}
        return pa.table(named | columns | {"radius": pa.concat_arrays([nulls(n, pa.float64()), pa.array(radius, pa.float64())])})

    def at_home(key, s, p):
        src, dst, dist, reach = search(s, p, others)
        tree, visits = trees.get(tuple(k.as_py() for k in key[: len(by)])), None
        if tree is not None and s.num_rows:
            who, leaves = tree.touched(_places(s), reach)
            away = leaves != key[len(by)].as_py()
            visits = who[away], leaves[away], reach[who[away]]
        return rows(key, s, p, src, dst, dist, visits)

    def abroad(key, s, p):
        src, dst, dist, _ = search(s, p, others)
        within = dist <= s["radius"].to_numpy()[src]
        return rows(key, s, p, src[within], dst[within], dist[within])

    found = _met(sources, points, by, at_home, schema)
    if trees:
        found = settled(found)
        visits = found.where("dst is null").select(*by, F.col("src").alias("cell"), *AXES, "leaf", "radius")
        found = found.where("dst is not null").unionByName(_met(visits, points, by, abroad, schema))
    order = Window.partitionBy(*by, "src").orderBy(F.round("dist", 9), "dst")
    ranked = found.select(*by, "src", "dst", "dist").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= others)
