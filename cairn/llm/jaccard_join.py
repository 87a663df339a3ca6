"""Operator 2: the n-gram Jaccard join, exact, by signature trees.

A document is the set of 64-bit hashes of its distinct word windows. Documents of equal sets form a class, represented by
the smallest doc_id; only classes are compared. Two sets link when ``den * intersection >= num * union``.

1. Routing. In an order common to all sets, elements from rare to frequent, linked sets share one of their first
   n - ceil(n * num / den) + 1 elements. The order is by the number of classes that have the element (up to 255), then by its
   hash; elements of one class alone come first and meet nothing. Sets whose sizes allow a link meet at such elements, and
   what meets is joined to clusters, of which a link never leaves one. An element travels as its bucket, from the upper half
   of its hash, and the lower half, so that chance meetings, which cost time alone, stay as rare as buckets are small.
2. Signature trees. The sets of a cluster are cut in blocks, similar ones together, the top nodes of the cluster's tree. A
   node holds the OR and the AND of its members' bitmaps, which are as long as the sets ask for, and their size range. Pairs
   of nodes are traversed together, blocks in the DataFrame, smaller nodes within a task, and pruned if the sizes, or the most
   that members can overlap given the bitmaps, exclude a link. Pairs of leaves are verified on the sets themselves. Each
   block is first compared with itself and with the next one; the blocks that these links make one component with most others of
   their cluster, as near copies do, need not meet each other again.
3. Links become components; nothing of them is collected.

Rows: null and empty texts have an empty set and link with nothing. A text of fewer words than a window is one window, all
its words. Repeated rows of one doc_id count as one document of each text they have. A null doc_id links with nothing and has
a null class_id and component_id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec
from .common import stored, stored_at, tidy, worker_keeps
from .components import components, forest

BLOCK = 192
"""Sets of a block, at most."""
BLOCK_ELEMENTS = 1 << 20
"""Elements of a block, at most, but for a single larger set."""
LEAVES = 16
WORDS = 8, 1024
"""64-bit words of a bitmap, at least and at most: four bits for each element of the largest set."""
BUCKETS = 4
"""Buckets of elements for each partition of a shuffle."""
SLICE_ELEMENTS, SLICE_SETS = 1_500_000, 60_000
CROWD = 64
"""Sets of a slice that share an element from which on it is sent once."""
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """When two sets link: ``den * intersection >= num * union``."""

    num: int
    den: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Elements of which linked sets share one."""
        return n - -(-n * self.num // self.den) + 1


def sets(chunk: textvec.Chunk, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct window hashes of each text."""
    w = textvec.words(chunk)
    hashes, at = textvec.windows(w.hash, w.of, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h = np.sort(hashes[a:b])
        if len(h) > 1:
            new = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=new[1:])
            h = h[new]
        yield h


def _class(ordered: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers."""
    with np.errstate(over="ignore"):
        x = textvec.mix(np.array([ordered.sum(dtype=np.uint64), textvec.mix(ordered ^ _U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)]))
    return tuple(x.view(np.int64).tolist())


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    for chunk in textvec.chunks(batch.column(1)):
        for ordered in sets(chunk, width):
            yield at, ordered
            at += 1


def classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (the class of the set), low (its least hash, halved)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps(None)
        for batch in batches:
            found = [(len(h), *((*_class(h), int(h[0]) >> 1) if len(h) else (0, 0, 0))) for _, h in _rows(batch, width)]
            columns = (pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ((), (), (), ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "c1", "c2", "low"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_shingles long, c1 long, c2 long, low long")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """From the upper half of the hashes, in their order."""
    return (((hashes >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int32)


def _half(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U(0xFFFFFFFF)).astype(np.uint32)


def _element(bucket: np.ndarray | int, half: np.ndarray) -> np.ndarray:
    """What stands for an element where several buckets' meet."""
    return np.asarray(bucket).astype(np.int64) << 32 | half.astype(np.int64)


def _pieces(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each run of a bucket: its number, and a blob of its part of the columns (their length first)."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut, len(bucket))
    blobs = [np.array([j - i], np.int64).tobytes() + b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return bucket[cut], blobs


def _columns(blob: pa.Scalar | memoryview, *kinds: type) -> list[np.ndarray]:
    """What ``_pieces`` packed."""
    data = memoryview(blob.as_buffer()) if isinstance(blob, pa.Scalar) else blob
    n, at, out = int(np.frombuffer(data[:8], np.int64)[0]), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows by their first column, whose equal values follow one another."""
    now, rows = None, []
    for batch in batches:
        for key, *values in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            if key != now and now is not None:
                yield now, rows
                rows = []
            now = key
            rows.append(values)
    if now is not None:
        yield now, rows


def meetings(docs: DataFrame, width: int, rule: Rule) -> DataFrame:
    """Edges (a, b) between classes (c1) that meet, reduced within tasks.

    Texts are read in slices. A slice sends (element, document) to the element's bucket, and gets back how many classes
    have it if not the document's alone. Elements that many of the slice's own documents have are sent once with their
    count, and answered once; and where sets meet, those of a slice whose sizes form an unbroken run are joined there and
    sent as one. So no frequent element gathers the corpus in one bucket.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * BUCKETS

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps(None)
        part, count, seen = TaskContext.get().partitionId(), 0, set()
        held, owners, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal count
            sizes = np.array([len(h) for h in held], np.int64)
            element = np.concatenate(held)
            doc = np.repeat(np.arange(len(held)), sizes).astype(np.uint16)
            order = np.argsort(element, kind="stable")
            element, doc = element[order], doc[order]
            first = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
            often = np.diff(np.append(first, len(element)))
            crowd = np.repeat(often >= CROWD, often)
            top = first[often >= CROWD]
            one, blobs = _pieces(_bucket(element[~crowd], buckets), _half(element[~crowd]), doc[~crowd])
            many = often[often >= CROWD]
            two, totals = _pieces(_bucket(element[top], buckets), _half(element[top]), many.astype(np.uint32))
            facts = [np.array([len(held)], np.int64).tobytes() + np.array(owners, np.int64).tobytes() + sizes.tobytes(), np.array([len(top), int(crowd.sum())], np.int64).tobytes() + _element(_bucket(element[top], buckets), _half(element[top])).tobytes() + np.repeat(np.arange(len(top), dtype=np.uint32), many).tobytes() + doc[crowd].tobytes()]
            slice_id = (part << 32) + count
            bucket = np.concatenate([one, two, [slice_id % buckets] * 2]).astype(np.int32)
            kind = np.repeat(np.array([0, 1, 2, 3], np.int32), [len(one), len(two), 1, 1])
            count += 1
            held.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), slice_id)), pa.array(kind), pa.array([*blobs, *totals, *facts], pa.binary())], ["bucket", "slice", "kind", "blob"])

        for batch in batches:
            for _, h in _rows(batch, width):
                if not len(h) or (c := _class(h)[0]) in seen:
                    continue
                if len(seen) >= 200_000:  # which only saves repeated work
                    seen.clear()
                seen.add(c)
                held.append(h)
                owners.append(c)
                size += len(h)
                if size >= SLICE_ELEMENTS or len(held) >= SLICE_SETS:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        tidy()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers to slices, after their bucket: kind 4: element, document, count of classes; kind 5: element, count. Facts go on as they are."""
        for bucket, rows in _groups(batches):
            single, crowds = [], []
            slices, kinds, blobs, at = [], [], [], 0
            for slice_id, kind, blob in rows:
                if kind.as_py() > 1:
                    slices.append(slice_id.as_py())
                    kinds.append(kind.as_py())
                    blobs.append(blob.as_py())
                else:
                    (crowds if kind.as_py() else single).append((slice_id.as_py(), *_columns(blob, np.uint32, np.uint32 if kind.as_py() else np.uint16)))
            element = np.concatenate([np.zeros(0, np.uint32), *(e for _, e, _ in single), *(e for _, e, _ in crowds)])
            weight = np.concatenate([np.ones(sum(len(e) for _, e, _ in single), np.int64), *(n.astype(np.int64) for _, _, n in crowds)])
            order = np.argsort(element, kind="stable")
            ordered = element[order]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
            total = np.minimum(np.add.reduceat(weight[order], first), 255) if len(element) else weight
            have = np.empty(len(element), np.uint8)
            have[order] = np.repeat(total, np.diff(np.append(first, len(ordered))))
            for code, part in ((4, single), (5, crowds)):
                for slice_id, e, other in part:
                    n = have[at : at + len(e)]
                    at += len(e)
                    keep = n > 1
                    columns = (e[keep], other[keep], n[keep]) if code == 4 else (e, n)
                    if len(columns[0]):
                        slices.append(slice_id)
                        kinds.append(code)
                        blobs.append(np.array([bucket], np.int64).tobytes() + _pieces(np.zeros(len(columns[0]), np.int32), *columns)[1][0])
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "kind", "blob"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each slice's sets the shared elements among their first ones, where they meet: kind 0 to the element's bucket
        runs of sets (element, one of them, least and largest size); kind 1 what a run joins."""
        for slice_id, rows in _groups(batches):
            parts: dict[int, list] = {}
            for kind, blob in rows:
                parts.setdefault(kind.as_py(), []).append(memoryview(blob.as_buffer()))

            def answered(kind: int, *kinds: type, parts=parts) -> list:
                found = ((int(np.frombuffer(b[:8], np.int64)[0]), _columns(b[8:], np.uint32, *kinds)) for b in parts.get(kind, []))
                return [(_element(bucket, e), *more) for bucket, (e, *more) in found]

            owner, size = _columns(parts[2][0], np.int64, np.int64)
            tops, times = np.frombuffer(parts[3][0][:16], np.int64).tolist()
            top, which, crowd_doc = (np.frombuffer(parts[3][0][a:b], kind) for a, b, kind in ((16, 16 + 8 * tops, np.int64), (16 + 8 * tops, 16 + 8 * tops + 4 * times, np.uint32), (16 + 8 * tops + 4 * times, None, np.uint16)))
            answers, known = answered(4, np.uint16, np.uint8), answered(5, np.uint8)
            if known:
                e, n = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(e)
                answers.append((top[which], crowd_doc, n[order][np.searchsorted(e[order], top)][which]))
            if not answers:
                continue
            element, doc, n = (np.concatenate(x) for x in zip(*answers, strict=True))
            order = np.lexsort((element, n, doc))
            element, doc = element[order], doc[order].astype(np.int64)
            shared = np.bincount(doc, minlength=len(size))
            begin = np.cumsum(shared) - shared
            wanted = rule.prefix(size) - (size - shared)
            keep = np.arange(len(doc)) - begin[doc] < wanted[doc]
            element, doc = element[keep], doc[keep]
            order = np.lexsort((size[doc], element))
            element, doc = element[order], doc[order]
            begin, end, a, b = runs(element, size[doc], size[doc], owner[doc])
            element, first, last = element[begin], doc[begin], doc[end]
            bucket, blobs = _pieces((element >> 32).astype(np.int32), _half(element.view(np.uint64)), owner[first], size[first].astype(np.uint32), size[last].astype(np.uint32))
            blobs += _pieces(np.zeros(len(a), np.int32), a, b)[1]
            kind = np.arange(len(blobs)) >= len(bucket)
            bucket = np.append(bucket, np.full(int(kind.sum()), slice_id % buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(kind.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            joined = [_columns(blob, np.int64, np.int64) for kind, blob in rows if kind.as_py()]
            met_here = [_columns(blob, np.uint32, np.int64, np.uint32, np.uint32) for kind, blob in rows if not kind.as_py()]
            if met_here:
                element, owner, low, high = (np.concatenate(x) for x in zip(*met_here, strict=True))
                order = np.lexsort((low, element))
                joined.append(runs(element[order].astype(np.int64), low[order].astype(np.int64), high[order].astype(np.int64), owner[order])[2:])
            a, b = forest(*(np.concatenate(x) for x in zip(*joined, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def runs(element: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of rows in order of element and low, in which each can link, by size, with one before it: where they begin and
        end, and edges that join them. Of a run, what is between its least and largest size can link with it too."""
        if not len(element):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        group = np.cumsum(np.append(True, element[1:] != element[:-1])).astype(np.int64)
        reach = np.maximum.accumulate((group << 32) + high) - (group << 32)
        near = (group[1:] == group[:-1]) & (reach[:-1] * rule.den >= low[1:] * rule.num)
        begin = np.flatnonzero(np.append(True, ~near))
        different = near & (owner[1:] != owner[:-1])
        return begin, np.append(begin[1:], len(element)) - 1, *forest(owner[1:][different], owner[:-1][different])

    read = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sliced, "bucket int, slice long, kind int, blob binary")
    answers = read.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(counted, "slice long, kind int, blob binary")
    routes = answers.repartition(partitions, "slice").sortWithinPartitions("slice").mapInArrow(routed, "bucket int, kind int, blob binary")
    return routes.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(met, "a long, b long")


def bitmap_words(largest: int) -> int:
    """64-bit words of bitmaps of sets of up to ``largest`` elements: a power of two."""
    return min(max(WORDS[0], 1 << max(0, (largest // 16 - 1).bit_length())), WORDS[1])


def bitmaps(members: list[np.ndarray], words: int) -> np.ndarray:
    out = np.zeros((len(members), words), np.uint64)
    for row, m in zip(out, members, strict=True):
        spot = (m >> _U(20)) % _U(64 * words)
        np.bitwise_or.at(row, (spot >> _U(6)).astype(np.int64), _U(1) << (spot & _U(63)))
    return out


class Tree:
    """A signature tree over sorted sets: levels of nodes from the leaves up; the nodes of a level halve in number."""

    def __init__(self, members: list[np.ndarray], words: int):
        low = np.array([m[0] >> _U(1) for m in members], np.uint64) if members else np.zeros(0, np.uint64)
        size = np.array([len(m) for m in members], np.int64)
        self.order = np.lexsort((low, size))
        self.sets = [members[i] for i in self.order]
        bits, size = bitmaps(self.sets, words), size[self.order]
        self.levels = [(bits, bits, size, size)]
        width = LEAVES
        while len(self.levels[-1][0]) > 1:
            any_, all_, low, high = self.levels[-1]
            at = np.arange(0, len(any_), width)
            self.levels.append((np.bitwise_or.reduceat(any_, at), np.bitwise_and.reduceat(all_, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
            width = 4

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of nodes: the nodes one level down, and where they come from."""
        width = LEAVES if level == 1 else 4
        count = np.minimum(width, len(self.levels[level - 1][0]) - nodes * width)
        return textvec.ragged(nodes * width, count), np.repeat(np.arange(len(nodes)), count)


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of node pairs, whether members can link: by sizes, and by the most that they can overlap.

    A bit that all members of a node have, and none of the other, is an element without a partner there.
    """
    any_x, all_x, low_x, high_x = (v[i] for v in x)
    any_y, all_y, low_y, high_y = (v[j] for v in y)
    alone_x = np.bitwise_count(all_x & ~any_y).sum(1, dtype=np.int64)
    alone_y = np.bitwise_count(all_y & ~any_x).sum(1, dtype=np.int64)
    most = np.minimum(high_x - alone_x, high_y - alone_y)
    return (num * low_x <= den * high_y) & (num * low_y <= den * high_x) & ((num + den) * most >= num * (low_x + low_y))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = len(a) - 1
    return int((a[at] == b).sum())


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """A set of links that connects what links at all: pairs already connected are not verified.

    Indices into left, and into right after it; without right, pairs within left.
    """
    words = bitmap_words(max(map(len, left + (right or [])), default=0))
    x = Tree(left, words)
    y = x if right is None else Tree(right, words)
    parent = list(range(len(left) + (0 if right is None else len(right))))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found: list[tuple[int, int]] = []
    if not left or right is not None and not right:
        return found
    a, b, la, lb = np.zeros(1, np.int64), np.zeros(1, np.int64), len(x.levels) - 1, len(y.levels) - 1
    while len(a):
        keep = possible(x.levels[la], a, y.levels[lb], b, num, den)
        a, b = a[keep], b[keep]
        if not la and not lb:
            break
        if la >= lb:
            a, at = x.below(la, a)
            b, la = b[at], la - 1
            if right is None and la < lb:
                b, at = y.below(lb, b)
                a, lb = a[at], lb - 1
        else:
            b, at = y.below(lb, b)
            a, lb = a[at], lb - 1
        if right is None:
            keep = a <= b
            a, b = a[keep], b[keep]
    shift = 0 if right is None else len(left)
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if right is None and i == j:
            continue
        u, v = int(x.order[i]), int(y.order[j]) + shift
        if (ru := root(u)) == (rv := root(v)):
            continue
        common = overlap(x.sets[i], y.sets[j])
        if den * common >= num * (len(x.sets[i]) + len(y.sets[j]) - common):
            parent[ru] = rv
            found.append((u, v))
    return found


def _cut(members: DataFrame, rule: Rule) -> DataFrame:
    """Members with their block. Members of a cluster come in order of size bands and of their least element, which similar
    sets mostly share, and are cut into blocks in that order, within partitions, so that no task holds a cluster."""
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(rule.den / rule.num)).cast("int")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, first, sets_, elements = (TaskContext.get().partitionId() << 32) - 1, None, 0, 0, 0
        for batch in batches:
            out = []
            for cluster, of, n in zip(*(batch.column(c).to_pylist() for c in ("cluster", "band", "n_shingles")), strict=True):
                if cluster != now or sets_ >= BLOCK or elements + n > BLOCK_ELEMENTS or of != first and sets_ >= BLOCK // 4:
                    block, now, first, sets_, elements = block + 1, cluster, of, 0, 0
                sets_, elements = sets_ + 1, elements + n
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int64())], ["rep", "c1", "n_shingles", "cluster", "block"])

    order = ["cluster", "band", "low", "c1"]
    rows = members.select("rep", "c1", "n_shingles", "cluster", "low", band.alias("band")).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(blocked, "rep long, c1 long, n_shingles long, cluster long, block long")


def _packed(docs: DataFrame, placed: DataFrame, width: int, rule: Rule) -> DataFrame:
    """A row for each block: cluster, block, low and high (sizes), any and all (bitmaps), ids, sizes and sets, and links within."""
    largest = placed.groupBy("cluster").agg(F.max("n_shingles").alias("largest"))
    wanted = placed.join(largest, "cluster").select("rep", "c1", "cluster", "block", "largest").hint("merge")  # it grows with the input
    text = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, blobs = [], []
            for at, h in _rows(batch, width):
                if len(h) and _class(h)[0] == batch.column(2)[at].as_py():  # of several texts of one id, the class's own
                    right.append(at)
                    blobs.append(h.tobytes())
            kept = batch.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(4), kept.column(3), kept.column(5), kept.column(0), pa.array(blobs, pa.binary())], ["block", "cluster", "largest", "rep", "blob"])
        tidy()

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches):
            distinct = {rep.as_py(): np.frombuffer(blob.as_buffer(), np.uint64) for _, _, rep, blob in rows}  # rows may be repeated
            ids, members = list(distinct), list(distinct.values())
            bits = bitmaps(members, bitmap_words(rows[0][1].as_py()))
            size = np.array([len(m) for m in members], np.int64)
            pairs = np.array(tree_links(members, None, rule.num, rule.den), np.int64).reshape(-1, 2)
            ids = np.array(ids, np.int64)
            blobs = (ids.tobytes(), size.tobytes(), np.concatenate(members).tobytes(), ids[pairs].tobytes())
            both = [pa.array([x.view(np.int64).tolist()], pa.list_(pa.int64())) for x in (np.bitwise_or.reduce(bits), np.bitwise_and.reduce(bits))]
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0].as_py()]), pa.array([block]), pa.array([int(size.min())]), pa.array([int(size.max())]), *both, *(pa.array([x], pa.binary()) for x in blobs)], ["cluster", "block", "low", "high", "any", "all", "ids", "sizes", "sets", "links"])
        tidy()

    held = text.select("rep", "text", "c1", "cluster", "block", "largest").mapInArrow(encoded, "block long, cluster long, largest long, rep long, blob binary")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartition(partitions, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(packs, "cluster long, block long, low long, high long, any array<long>, all array<long>, ids binary, sizes binary, sets binary, links binary")


def _can_link(rule: Rule) -> Column:
    """Of a pair of blocks (x, y), whether members can link, as ``possible`` decides for smaller nodes."""

    def alone(all_: str, any_: str) -> Column:
        return F.aggregate(F.zip_with(all_, any_, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda a, b: a + b)

    num, den = rule.num, rule.den
    low, high = F.col("low") + F.col("low_y"), F.least(F.col("high") - alone("all", "any_y"), F.col("high_y") - alone("all_y", "any"))
    return (F.col("low") * num <= F.col("high_y") * den) & (F.col("low_y") * num <= F.col("high") * den) & (high * (num + den) >= low * num)


def _verified(pairs: DataFrame, blocks: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) between the members of pairs of blocks (block, block_y)."""

    def members(ids: pa.Scalar, sizes: pa.Scalar, sets_: pa.Scalar) -> tuple[np.ndarray, list[np.ndarray]]:
        ends = np.cumsum(np.frombuffer(sizes.as_buffer(), np.int64))
        return np.frombuffer(ids.as_buffer(), np.int64), np.split(np.frombuffer(sets_.as_buffer(), np.uint64), ends[:-1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                (left_ids, left), (right_ids, right) = members(*row[:3]), members(*row[3:])
                ids = np.concatenate([left_ids, right_ids])
                found = np.array(tree_links(left, right, rule.num, rule.den), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], ["a", "b"])
        tidy()

    x = blocks.select("block", "ids", "sizes", "sets")
    y = blocks.select(*(F.col(c).alias(f"{c}_y") for c in x.columns))
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(x, "block").join(y, "block_y").select("ids", "sizes", "sets", "ids_y", "sizes_y", "sets_y")
    return both.repartition(partitions).mapInArrow(rows, "a long, b long")


def links(docs: DataFrame, members: DataFrame, width: int, rule: Rule) -> DataFrame:
    """node, root: for each representative that isn't the least of its component, that least one. members: rep, c1, n_shingles, cluster, low."""
    placed = stored(_cut(members, rule), "placed")
    blocks, _ = stored_at(_packed(docs, placed, width, rule), "blocks", rows=64)
    slim = blocks.select("cluster", "block", "low", "high", "any", "all")
    other = slim.select("cluster", *(F.col(c).alias(f"{c}_y") for c in slim.columns[1:]))
    following = blocks.select("cluster", "block", F.lead("block").over(Window.partitionBy("cluster").orderBy("block")).alias("block_y")).where("block_y is not null")
    near = slim.join(following, ["cluster", "block"]).join(other, ["cluster", "block_y"]).where(_can_link(rule)).select("block", "block_y")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                pairs = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    first, _ = stored_at(blocks.select("links").mapInArrow(within, "a long, b long").unionByName(_verified(near, blocks, rule)), "links", rows=8)
    roots = stored(components(first), "roots")
    # Blocks that lie within the component of most blocks of their cluster need not meet each other.
    owned = placed.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    pure = owned.groupBy("cluster", "block").agg(F.min("root").alias("root"), F.max("root").alias("root_to"))
    pure = stored(pure.select("cluster", "block", F.when(F.col("root") == F.col("root_to"), F.col("root")).alias("root")), "pure")
    main = pure.where("root is not null").groupBy("cluster", "root").count().groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    several = pure.groupBy("cluster").count().where("count > 2").select("cluster")
    known = slim.join(several, "cluster").join(pure, ["cluster", "block"]).join(main, "cluster", "left")
    minor = known.where("root is null or root != main")
    other = known.select("cluster", *(F.col(c).alias(f"{c}_y") for c in ("block", "low", "high", "any", "all", "root")), ((F.col("root") == F.col("main")) & F.col("main").isNotNull()).alias("major_y"))
    once = F.coalesce("major_y", F.lit(False)) | (F.col("block") < F.col("block_y"))
    apart = F.col("root").isNull() | F.col("root_y").isNull() | (F.col("root") != F.col("root_y"))
    far = minor.join(other, "cluster").where((F.col("block") != F.col("block_y")) & once & apart).where(_can_link(rule)).select("block", "block_y")
    done = following.select("block", "block_y").unionByName(following.select(F.col("block_y").alias("block"), F.col("block").alias("block_y")))
    second, _ = stored_at(_verified(far.join(done, ["block", "block_y"], "left_anti"), blocks, rule), "links", rows=8)
    # What the first links made one is one node from here on.
    for side in ("a", "b"):
        second = second.join(roots.select(F.col("node").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    further = stored(components(second), "roots").select(F.col("node").alias("root"), F.col("root").alias("least"))
    return roots.join(further, "root", "left").select("node", F.coalesce("least", "root").alias("root")).unionByName(further.select(F.col("root").alias("node"), F.col("least").alias("root")))


def jaccard_join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of the same set), component_id (smallest doc_id reachable by links)."""
    rule = Rule(num, den)
    all_ = stored(classes(docs, width), "classes")
    docs = docs.where("doc_id is not null")
    full = all_.where("n_shingles > 0 and doc_id is not null")
    reps = stored(full.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("low").alias("low")), "reps")
    cluster = components(meetings(docs, width, rule)).select(F.col("node").alias("c1"), F.col("root").alias("cluster"))
    inner = cluster.unionByName(cluster.select(F.col("cluster").alias("c1"), "cluster").distinct())
    members = stored(reps.join(inner, "c1").select("rep", "c1", "n_shingles", "cluster", "low"), "members")
    joined = links(docs, members, width, rule).select(F.col("node").alias("rep"), "root")
    roots = reps.join(joined, "rep", "left").select("c1", "c2", "n_shingles", "rep", F.coalesce("root", "rep").alias("component"))
    out = all_.join(roots, ["c1", "c2", "n_shingles"], "left")
    of = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return out.select("doc_id", "n_shingles", of("rep").alias("class_id"), of("component").alias("component_id"))
