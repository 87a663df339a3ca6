"""Operator 8: near-duplicate vectors by a subspace pigeonhole join, exact.

Vectors of one label are compared by cosine. Unit vectors are rotated by a fixed random rotation and split into blocks of
few dimensions. Two vectors within the squared distance that the threshold allows are, in some block, within that block's
proportional share of it. So each block is range-joined under its share, at any size of the label:

1. Across tasks. A block's space is cut in cells, twice as wide as the range, along its first dimensions, more of them the
   more vectors the label has. A vector stands in its own cell and in those above that its range touches, so that two vectors
   within the range meet in one cell where in each dimension one of them at least is at home.
2. Within a task. The vectors of a cell are halved at medians, and what is within the range of the cut on either side meets
   across it, until few are left, whose distances are taken.

The union of the blocks' candidates is verified on the vectors themselves, in double precision; a pair counts in the first
block that admits it, so in one place only. Equal vectors form a class and are compared once. A cell of very many vectors is
dealt out in parts of bounded size, and pairs of parts are joined, each pair in one task. Links are counted where they are
found and reduced to stars; the pairs themselves go nowhere.

Rows: a null label or vector, one with null or non-finite components, an empty and a zero vector link with nothing, as do
vectors of different lengths. Vectors of any finite size are compared: they are scaled by powers of two first. Repeated rows
of one vec_id are one vector of each value they have. A null vec_id links with nothing, has a null component_id and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .components import components, forest

BLOCKS = 8
PART = 1 << 14
"""About so many vectors a part; about so many at home in a cell, if a label is spread out."""
THIN = 2.3
"""By how much a dimension's cells thin out a label that is spread out."""
FEW = 1 << 16
"""Pairs of so few vectors are compared without further cuts."""
SLACK = 1e-6
"""Added to the blocks' shares: what rounding may take."""


def rotation(dims: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component to between 0.5 and 1: no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotated(u: np.ndarray) -> np.ndarray:
    """The rotation, summed in one order whatever rows come together, so that all tasks see the same numbers."""
    r, out = rotation(u.shape[1]), np.zeros_like(u)
    for i in range(u.shape[1]):
        out += u[:, i : i + 1] * r[i]
    return out


def bounds(dims: int) -> np.ndarray:
    """Where blocks begin, and the end."""
    return np.linspace(0, dims, min(BLOCKS, dims) + 1).round().astype(int)


def shares(dims: int, threshold: float) -> np.ndarray:
    """Of each block, the squared distance within which one block at least of two linked vectors is."""
    return 2 * (1 - threshold) * np.diff(bounds(dims)) / dims + SLACK


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def placed(y: np.ndarray, radius: float, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of a block's vectors, cut along its first ``depth`` dimensions: who, the cell, and a bit for each dimension
    in which the vector is a visitor, not at home."""
    who, code, away = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y), np.int32)
    for k in range(min(depth, y.shape[1])):
        x = y[who, k]
        own, above = (np.floor(v / (2 * radius)).astype(np.int64) for v in (x, x + radius))
        up = above > own
        who, code, away = (np.concatenate(v) for v in ((who, who[up]), (code * 1_000_003 + own, code[up] * 1_000_003 + above[up]), (away, away[up] | np.int32(1 << k))))
    return who, code, away


def cells(batches: Iterator[pa.RecordBatch], threshold: float, whole: bool) -> Iterator[pa.RecordBatch]:
    """In: rep, space, dims, depth, vector, copies. Out, for each cell that a vector is in: space, block, cell; and, if ``whole``, away, rep, copies, vector."""
    names = ["space", "block", "cell", "away", "rep", "copies", "vector"]
    for batch in batches:
        dims, depth = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for n in np.unique(dims):
            for g in np.unique(depth[dims == n]):
                rows = np.flatnonzero((dims == n) & (depth == g))
                y, at, share = rotated(unit(matrix(batch.column(4).take(pa.array(rows))))), bounds(n), shares(n, threshold)
                for b in range(len(share)):
                    who, code, away = placed(y[:, at[b] : at[b + 1]], float(np.sqrt(share[b])), int(g))
                    part = batch.take(pa.array(rows[who]))
                    columns = [part.column(1), pa.array(np.full(len(who), b, np.int32)), pa.array(code), pa.array(away), part.column(0), part.column(5), part.column(4)]
                    yield pa.RecordBatch.from_arrays(columns if whole else columns[:3], names if whole else names[:3])


def square(d: np.ndarray) -> np.ndarray:
    """Squared lengths, added up in one order, so that all tasks decide alike."""
    out = d[:, 0] * d[:, 0]
    for k in range(1, d.shape[1]):
        out += d[:, k] * d[:, k]
    return out


def in_range(y: np.ndarray, z: np.ndarray | None, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, k) of rows of y and z, or i < k of y alone, whose squared distance is ``share`` at most, in batches."""
    radius = np.sqrt(share) + 1e-9
    stack = [(np.arange(len(y)), None if z is None else np.arange(len(z)))]
    while stack:
        a, b = stack.pop()
        pairs = len(a) * len(a) // 2 if b is None else len(a) * len(b)
        if not pairs:
            continue
        other, right = (y, a) if b is None else (z if z is not None else y, b)
        if pairs > FEW:
            k = int(np.argmax(y[a].std(0) + other[right].std(0)))
            x, w = y[a, k], other[right, k]
            cut = np.median(x)
            low, high = a[x <= cut], a[x > cut]
            if b is None:
                below, above = a[(x <= cut) & (x >= cut - radius)], a[(x > cut) & (x <= cut + radius)]
                after = [(low, None), (high, None), (below, above)]
                cost = (len(low) ** 2 + len(high) ** 2) // 2 + len(below) * len(above)
            else:
                after = [(low, right[w <= cut + radius]), (high, right[w >= cut - radius])]
                cost = sum(len(p) * len(q) for p, q in after)
            if cost <= 0.9 * pairs:
                stack += after
                continue
        far = other[right]
        length = square(far)
        step = max(1, (1 << 18) // len(right))
        for lo in range(0, len(a), step):
            mine = y[a[lo : lo + step]]
            i, j = np.nonzero((square(mine) - share - 1e-9)[:, None] + length <= (2 * mine) @ far.T)
            if b is None:
                i, j = i[i + lo < j], j[i + lo < j]
            exact = square(mine[i] - far[j]) <= share
            yield a[lo + i[exact]], right[j[exact]]


def compare(left: tuple, right: tuple | None, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of a block between two parts of a cell, or within one: for each vector those linked with it, and edges.

    Parts are (ids, away, copies, vectors). Returns ids, counts, edges (a, b).
    """
    ids, away, copies, x = left
    others, away_z, copies_z, z = left if right is None else right
    at, share = bounds(x.shape[1]), shares(x.shape[1], threshold)
    y = rotated(unit(x))
    yz = y if right is None else rotated(unit(z))
    x, z = scaled(x), scaled(z)
    length, length_z = (x * x).sum(1), (z * z).sum(1)
    n, n_z, a, b = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64), [], []
    rows = slice(at[block], at[block + 1])
    for p, q in in_range(np.ascontiguousarray(y[:, rows]), None if right is None else np.ascontiguousarray(yz[:, rows]), share[block]):
        keep = (away[p] & away_z[q]) == 0
        p, q = p[keep], q[keep]
        for j in range(block):  # not if an earlier block admits the pair
            keep = square(y[p, at[j] : at[j + 1]] - yz[q, at[j] : at[j + 1]]) > share[j]
            p, q = p[keep], q[keep]
        for start in range(0, len(p), 1 << 16):
            i, k = p[start : start + (1 << 16)], q[start : start + (1 << 16)]
            good = (x[i] * z[k]).sum(1) / np.sqrt(length[i] * length_z[k]) >= threshold
            i, k = i[good], k[good]
            n += np.bincount(i, copies_z[k], len(ids)).astype(np.int64)
            n_z += np.bincount(k, copies[i], len(others)).astype(np.int64)
            if len(i):
                u, v = forest(ids[i], others[k])
                a.append(u)
                b.append(v)
        if len(a) > 64:
            u, v = forest(np.concatenate(a), np.concatenate(b))
            a, b = [u], [v]
    a, b = forest(np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])
    return np.concatenate([ids, others]), np.concatenate([n, n_z]), a, b


def found(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows space, block, cell, low, high (the parts that meet), side, away, rep, copies, vector in that order. Links as rep, other, n: counts of a vector (other is itself), and edges with n 0."""
    now, block, sides = None, 0, ([], [])

    def done() -> pa.RecordBatch:
        within = now[3] == now[4]
        if not sides[0] or not (within or sides[1]):  # a part of which no vector is in the cell
            return empty
        left, right = ([np.concatenate(c) for c in zip(*side, strict=True)] if side else None for side in sides)
        ids, counts, a, b = compare(left, right, block, threshold)
        seen = counts > 0
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((ids[seen], a), (ids[seen], b), (counts[seen], np.zeros(len(a), np.int64)))], names)

    names = ["rep", "other", "n"]
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names)
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(6)])
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            *task, side = key[:, lo].tolist()
            if task != now and now is not None:
                yield done()
                sides = ([], [])
            now, block = task, task[1]
            part = batch.slice(lo, hi - lo)
            sides[side].append((part.column(7).to_numpy(), part.column(6).to_numpy(), part.column(8).to_numpy(), matrix(part.column(9))))
    if now is not None:
        yield done()
    tidy()


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, embedding, label)."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("vector"), F.col("label").cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False))
    sound &= F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    sound &= F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    # The hash comes first among the keys, so that sorts hardly ever compare vectors.
    own = rows.where(sound).select("vec_id", F.xxhash64("label", "vector").alias("hash"), "label", "vector").distinct()
    classes = own.groupBy("hash", "label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumns({"space": F.xxhash64("label", F.size("vector")), "dims": F.size("vector")}), "vectors")
    depth = F.greatest(F.lit(0), F.ceil(F.log(F.count("*") / F.lit(float(PART))) / float(np.log(THIN)))).cast("int")
    spaces = classes.groupBy("space").agg(depth.alias("depth"), F.count("*").alias("classes")).where("classes > 1")
    placed_ = classes.join(spaces, "space").select("rep", "space", "dims", "depth", "vector", "copies")
    key = ["space", "block", "cell"]
    shape = "space long, block int, cell long"
    counted = placed_.mapInArrow(lambda it: cells(it, threshold, False), shape).groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n"))
    in_cells = placed_.mapInArrow(lambda it: cells(it, threshold, True), f"{shape}, away int, rep long, copies long, vector array<{kind}>")
    dealt = in_cells.join(counted.where("n > 1"), key).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = (F.col("part") > F.col("with")).cast("int").alias("side")
    tasks = dealt.select(*key, F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), side, "away", "rep", "copies", "vector")
    task = [*key, "low", "high"]
    tasks = tasks.repartition(partitions, *task).sortWithinPartitions(*task, "side")
    links = stored(tasks.mapInArrow(lambda it: found(it, threshold), "rep long, other long, n long"), "links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(links.where("rep != other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = classes.join(counts, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    of_class = of_class.select("hash", "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = own.join(of_class, ["hash", "label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
