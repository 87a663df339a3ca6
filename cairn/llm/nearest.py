"""Operator 13: nearest neighbours by inner product, by an exact block matrix join.

Queries are dealt in stripes of bounded size, candidates in stripes too; each task meets one stripe of both. It holds the
queries and streams the candidates, in ascending vec_id. Vectors are held as 8-bit codes times a scale; what is lost, the
residual's length, bounds the error of a product of codes:

    |q.c - scale * codes| <= |rest of q| |coded c| + |coded q| |rest of c| + |rest of q| |rest of c|

The products of a tile of codes are one integer matrix product. A pair survives if its upper bound reaches the least score in
the query's heap; survivors are computed on the original vectors in double precision, component by component, and go into
the heap of their query. Where most of a tile survives (copies within the error), a product in double precision with its own
error bound goes before. The heaps of all stripes are merged by rank.

Of equal vectors only the smallest vec_ids can be results, one more than are asked for (one may be the query's own), so no
other of them is sent; the ranked window drops them before its shuffle. Sent are queries x candidate stripes and candidates x
query stripes; no pair leaves a task unless it stands in a heap there.

Rows: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a vec_id.
Vectors of different lengths do not meet. Of rows that repeat a vec_id the one with the least vector counts. Scores of equal
size go by smaller vec_id. Inner products are taken to be finite. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

STRIPE_BYTES = 1 << 22
"""Of original query vectors that a task holds."""
STREAM_ROWS = 1 << 20
"""Candidates of a stripe; they are streamed, not held."""
TILE = (2048, 1024)
"""Queries and candidates of one product."""
DENSE = 0.05
"""Share of a tile's pairs from which on survivors are computed as a product first."""
EXACT_DIMS = 1000
"""Products of 8-bit codes over so many dimensions are whole numbers below 2**24, exact in single precision."""


class Coded:
    """Vectors as doubles, their 8-bit codes and scales, and lengths of the coded vectors and of the rests."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.scale = np.maximum(np.abs(x).max(1) / 127, np.finfo(float).tiny)
        codes = np.rint(x / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        coded = codes * self.scale[:, None]
        slack = 1 + 1e-9  # above what rounding takes from the lengths
        self.length, self.rest = (np.sqrt((v * v).sum(1)) * slack for v in (coded, x - coded))

    def __len__(self) -> int:
        return len(self.ids)

    def rows(self, lo: int, hi: int) -> Coded:
        part = object.__new__(Coded)
        for name, value in vars(self).items():
            setattr(part, name, value[lo:hi])
        return part


def coded_products(q: Coded, c: Coded) -> np.ndarray:
    """Integer products of all codes of a tile."""
    out = np.zeros((len(q), len(c)))
    for lo in range(0, q.codes.shape[1], EXACT_DIMS):
        out += q.codes[:, lo : lo + EXACT_DIMS].astype(np.float32) @ c.codes[:, lo : lo + EXACT_DIMS].astype(np.float32).T
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up component by component."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * c[:, k]
    return out


class Heaps:
    """For each query of a stripe the nearest candidates so far."""

    def __init__(self, queries: Coded, k: int):
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
        self.least = np.full(len(queries), -np.inf)

    def add(self, block: Coded) -> None:
        for lo in range(0, len(self.queries), TILE[0]):
            for at in range(0, len(block), TILE[1]):
                self._tile(lo, self.queries.rows(lo, lo + TILE[0]), block.rows(at, at + TILE[1]))

    def _tile(self, lo: int, q: Coded, c: Coded) -> None:
        product = coded_products(q, c)
        product *= q.scale[:, None]
        product *= c.scale
        rounding = 1e-15 * (q.x.shape[1] + 1000) * (q.length + q.rest)[:, None] * (c.length + c.rest)
        error = q.rest[:, None] * (c.length + c.rest) + q.length[:, None] * c.rest + rounding
        least = self._sure(product - error, self.least[lo : lo + len(q)])
        who, whom = np.nonzero(product + error >= least[:, None])
        if len(who) > DENSE * product.size:
            close = q.x @ c.x.T
            least = self._sure(close - rounding, least)
            keep = (close + rounding)[who, whom] >= least[who]
            who, whom = who[keep], whom[keep]
        keep = q.ids[who] != c.ids[whom]
        who, whom = who[keep], whom[keep]
        for a in range(0, len(who), 1 << 16):
            w, o = who[a : a + (1 << 16)], whom[a : a + (1 << 16)]
            score = exact(q.x[w], c.x[o])
            for i, s, other in zip((w + lo).tolist(), score.tolist(), (-c.ids[o]).tolist(), strict=True):
                heap = self.heaps[i]
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, other))
                elif (s, other) > heap[0]:
                    heapq.heapreplace(heap, (s, other))
            for i in np.unique(w + lo).tolist():
                if len(self.heaps[i]) == self.k:
                    self.least[i] = self.heaps[i][0][0]

    def _sure(self, lower: np.ndarray, least: np.ndarray) -> np.ndarray:
        """What a query's k-th best score is at least, by lower bounds of a tile that may hold the query itself."""
        at = lower.shape[1] - self.k - 1
        if at < 0 or not np.isneginf(least).any() and lower.shape[1] < TILE[1]:
            return least
        return np.maximum(least, np.partition(lower, at, axis=1)[:, at])

    def result(self) -> pa.RecordBatch:
        query = [i for i, heap in zip(self.queries.ids.tolist(), self.heaps, strict=True) for _ in heap]
        found = [x for heap in self.heaps for x in heap]
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array([-x[1] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.float64())], ["query_id", "vec_id", "score"])


def _coded(batch: pa.RecordBatch) -> Coded:
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return Coded(batch.column(0).to_numpy(), x.reshape(batch.num_rows, -1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the vectors that take part."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("v"))


def nearest(vectors: DataFrame, is_query, k: int = 20, stripe_bytes: int = STRIPE_BYTES, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector of which ``is_query`` (a column of vec_id) holds, its ``k`` nearest others."""
    spark = vectors.sparkSession
    good = stored(usable(vectors).select("vec_id", "v", F.size("v").alias("dims"), is_query.alias("asks")), "vectors")
    equal = Window.partitionBy("v").orderBy("vec_id")
    others = good.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).select("vec_id", "v", "dims")
    sizes = good.groupBy("dims").agg(F.count_if("asks").alias("asking"), F.count("*").alias("n"))
    # Stripes of each length of vector: by bytes held, by rows streamed, and as many as keep all cores at work.
    cores = spark.sparkContext.defaultParallelism
    down = F.ceil(F.col("asking") * F.col("dims") * 8 / stripe_bytes)
    across = F.greatest(F.ceil(F.col("n") / stream_rows), F.ceil(2 * cores / F.greatest("down", F.lit(1))))
    grid = {r["dims"]: (r["down"], r["across"]) for r in sizes.where("asking > 0").withColumn("down", down).withColumn("across", across).select("dims", "down", "across").collect()}
    if not grid:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = spark.createDataFrame([(d, a, b) for d, (a, b) in grid.items()], "dims int, down int, across int")

    def spread(side: DataFrame, mine: str, theirs: str) -> DataFrame:
        placed = side.join(F.broadcast(table), "dims").withColumn(mine, F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int"))
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).select("dims", "down", "across", "vec_id", "v")

    asking = spread(good.where("asks"), "down", "across").withColumn("side", F.lit(0))
    offered = spread(others, "across", "down").withColumn("side", F.lit(1))
    key = ["dims", "down", "across"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, heaps = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                here, part = tuple(keys[lo, :3].tolist()), pa.RecordBatch.from_arrays([batch.column(4).slice(lo, hi - lo), batch.column(5).slice(lo, hi - lo)], ["vec_id", "v"])
                if here != at:
                    if heaps is not None:
                        yield heaps.result()
                    at, held, heaps = here, [], None
                if keys[lo, 3] == 0:
                    held.append(part)
                elif held or heaps is not None:
                    if heaps is None:
                        heaps, held = Heaps(_coded(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), k), []
                    heaps.add(_coded(part))
        if heaps is not None:
            yield heaps.result()
        tidy()

    tiles = sum(a * b for a, b in grid.values())
    dealt = asking.unionByName(offered).select(*key, "side", "vec_id", "v").repartition(max(tiles, 1), *key).sortWithinPartitions(*key, "side", "vec_id")
    met = dealt.mapInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
