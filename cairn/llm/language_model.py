"""Operator 10: language-model scoring by a hierarchical Pitman-Yor model of order three.

Tokens are words (A-Z as a-z) and one end per text. A token's restaurant is that of the two tokens before it; its parent is
the restaurant of the one before; the parent of these is the root, over a uniform base on the training vocabulary and one
unknown word. Every context of the training texts has its own restaurants. A dish's tables in a restaurant are its customers
in the parent.

Seating is sampled by Gibbs sweeps: all customers of one dish in one restaurant are taken out and seated anew. Up to ``EXACT``
customers the number of tables is drawn from its exact conditional distribution, by generalised Stirling numbers; beyond that
too where tables are few, and where they are many from the normal distribution about the likeliest number. All dishes
of a sweep see the restaurants' totals of the sweep before. Each draw depends on its dish, restaurant and sweep alone, not
on where it runs. Predictive probabilities are averaged over the sweeps kept.

The corpus is gone through in ``passes`` passes, each for a share of the contexts. In a pass, texts are read in slices, and
tokens are dealt out by context, so that a context's restaurants are together with all that is asked of them; sweeps run
there. The restaurant of a word that is the context of very many tokens is split into several by the word before, each of
about ``GROUP`` tokens. Discounts and strengths of both levels are sampled between the passes from their likelihood over
all restaurants seated so far. The root is seated first, from the numbers of different words before each word.

A probability is A + B p, with A and B from the context and p the word's probability in the root. The ``TOP`` most frequent
words' p is known everywhere. Tokens of other words go to where the words are counted first, and from there, with p, to their contexts.

Rows: null and empty texts are the end alone. Repeated rows count, and are scored, each. Without training texts N and V are
0, and every token has the base probability 1 / (V + 1) = 1. The texts must come in the same order whenever they are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import discard, stored_at, tidy, worker_keeps

EXACT = 256
WIDTHS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, EXACT])
"""Dishes of up to so many customers are drawn together."""
FEW = 192
"""Tables from 1 to this many are drawn by their exact weights, between ratios that are interpolated over customers."""
LARGE = 4096
"""Restaurants of up to this many customers, and dishes of up to ``EXACT``, are counted by size; the likelihood of larger ones is summed."""
DISCOUNTS, STRENGTHS = np.arange(1, 20) / 20, np.array([0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0])
TOP = 65_535
RARE = 65_535
GROUP = 1 << 18
SLICE_TOKENS, SLICE_DOCS = 1_600_000, 30_000
MERGE = 1_200_000
"""Entries that a task holds before it merges them."""
LOOKED_TOKENS = 4_000_000
"""Tokens that a task looks up together."""
PART, SHELVES = 1 << 16, 1 << 12
"""A bucket's contexts lie on so many shelves, by hash; whole shelves of about ``PART`` tokens are seated together."""
BATCH_BYTES = 4 << 20
"""Bytes of blobs that are handed between Spark and Python at a time, or one larger blob."""
CROWD = 64
"""Times that a slice has three words in a row from which on they are asked about once."""
LEARNED = np.uint16(1 << 15)
"""Bit of a text's number that marks it as a training text."""
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def tokens(chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's texts: token hashes with ends, and tokens of each text."""
    w = textvec.words(chunk)
    return np.insert(w.hash, w.of[1:], textvec.END_TOKEN), np.diff(w.of) + 1


def before(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of whole texts the one before, and the one before that; before a text stand ends."""
    one = np.concatenate([[textvec.END_TOKEN], token[:-1]])
    two = np.concatenate([[textvec.END_TOKEN], one[:-1]])
    return one, np.where(one == textvec.END_TOKEN, textvec.END_TOKEN, two)


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs."""
    return textvec.mix(a ^ textvec.mix(b.astype(np.uint64) + _STEP))


def uniform(key: np.ndarray, *numbers: int) -> np.ndarray:
    """Numbers in 0 to 1, one for each key and the numbers."""
    salt = functools.reduce(lambda x, n: (x * 0x100000001B3 + n + 1) & (2**64 - 1), numbers, 0xCBF29CE484222325)
    return (textvec.mix(textvec.mix(key ^ _U(salt)) + _STEP) >> _U(11)).astype(np.float64) * 2.0**-53


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows of equal values begin, in ordered columns."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new)[:n])


# Counting words.


def grouped(keys: list[np.ndarray], more: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, more), in the order of a hash of both, with the sums of their counts."""
    key, second, count = np.concatenate(keys), np.concatenate(more), np.concatenate(counts)
    both = key + second.astype(np.uint64) * _STEP
    order = np.argsort(both)
    at = runs(both[order])
    return key[order[at]], second[order[at]], np.add.reduceat(count[order], at) if len(at) else count


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes: what is in order of hash is in order of bucket."""
    return (((hashes >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int32)


def _shelf(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Shelves are ranges of a bucket's hashes: what is in order of hash is in order of shelf too."""
    return ((((hashes >> _U(32)) * _U(buckets)) & _U(0xFFFFFFFF)) // _U((1 << 32) // SHELVES)).astype(np.uint16)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of equal buckets: bucket, begin, end."""
    at = runs(bucket).tolist() if len(bucket) else []
    return [(int(bucket[a]), a, b) for a, b in zip(at, [*at[1:], len(bucket)], strict=False)]


def _batches(blobs: list[bytes], **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of columns and a blob, about ``BATCH_BYTES`` at a time."""
    at = runs(np.cumsum([len(x) for x in blobs], dtype=np.int64) // BATCH_BYTES).tolist()
    for a, b in zip(at, [*at[1:], len(blobs)], strict=False):
        yield pa.RecordBatch.from_arrays([*(pa.array(c[a:b]) for c in columns.values()), pa.array(blobs[a:b], pa.binary())], [*columns, "blob"])


def _counted(learn: DataFrame, partitions: int) -> DataFrame:
    """bucket, blob of distinct (token, half a hash of the one before) with counts, merged within each task. learn: text."""

    def blobs(key: np.ndarray, second: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key)
        key, second, count = key[order], second[order], count[order].astype(np.uint32)
        cuts = _cuts(_bucket(key, partitions))
        yield from _batches([key[a:b].tobytes() + second[a:b].tobytes() + count[a:b].tobytes() for _, a, b in cuts], bucket=np.array([c for c, _, _ in cuts], np.int32))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps(None)
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for chunk in textvec.chunks(batch.column(0)):
                token, _ = tokens(chunk)
                half = (before(token)[0] >> _U(32)).astype(np.uint32)
                for x, y in zip(held, grouped([token], [half], [np.ones(len(token), np.int64)]), strict=True):
                    x.append(y)
                size += len(held[0][-1])
                if size > MERGE:
                    held = tuple([x] for x in grouped(*held))
                    size = len(held[0][0])
                    if size > MERGE // 2:
                        yield from blobs(*(x[0] for x in held))
                        held, size = ([], [], []), 0
        if size:
            yield from blobs(*grouped(*held))
        tidy()

    return learn.mapInArrow(rows, "bucket int, blob binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """The rows of each bucket (the first column), whose rows follow one another; they are dropped when the next bucket is asked for."""
    now, rows = None, []
    for batch in batches:
        for key, *values in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            if key != now and now is not None:
                yield now, rows
                rows.clear()
            now = key
            rows.append(values)
    if now is not None:
        yield now, rows


def _words(learn: DataFrame, partitions: int) -> tuple[DataFrame, str]:
    """bucket, blob of the training vocabulary: hash, count, and how many words come before it (customers in the root)."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            parts = []
            for (blob,) in rows:
                data, n = memoryview(blob.as_buffer()), len(blob.as_buffer()) // 16
                parts.append((np.frombuffer(data[: 8 * n], np.uint64), np.frombuffer(data[8 * n : 12 * n], np.uint32), np.frombuffer(data[12 * n :], np.uint32).astype(np.int64)))
            key, _, count = grouped(*map(list, zip(*parts, strict=True)))
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            at = runs(key)
            n1 = np.diff(np.append(at, len(key)))
            blob = key[at].tobytes() + np.add.reduceat(count, at).tobytes() + n1.astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])
        tidy()

    return stored_at(_counted(learn, partitions).mapInArrow(merged, "bucket int, blob binary"), "words", size=BATCH_BYTES)


def _unpacked(blob: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(blob.as_buffer())
    n = len(data) // 24
    return np.frombuffer(data[: 8 * n], np.uint64), np.frombuffer(data[8 * n : 16 * n], np.int64), np.frombuffer(data[16 * n :], np.int64)


# Seating.


def log_stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c, t up to n, by the recursion S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(n):
            stay = np.where(t <= c, out[c, 1:] + np.log(np.maximum(c - d * t, 0)), -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


@functools.lru_cache(maxsize=8)
def _stirling(d: float) -> np.ndarray:
    return log_stirling(d)


def _saddle(m: np.ndarray, c: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables t at which the saddle of S_d(c, t) is at 1 - exp(m), and the logarithm of (1 - exp(d m)) / d there."""
    f = -np.expm1(d * m) / d
    return c * f / np.maximum(-np.expm1(m), 1e-300) * np.exp((1 - d) * m), np.log(np.maximum(f, 1e-300))


@functools.lru_cache(maxsize=32)
def _saddle_table(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one customer, in order: log t, and the m of ``_saddle`` there."""
    m = -np.geomspace(800.0, 1e-12, 1 << 15)
    return np.log(np.maximum(_saddle(m, np.ones(len(m)), d)[0], 1e-320)), m


def large_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) for many customers: the integral for the coefficient of z ** c in its generating function, along a
    parabola about the branch point 1 that crosses the axis at the saddle point, or 1 / c left of 1 if that is nearer."""
    place, m = _saddle_table(d)
    out = np.zeros(len(c))
    some = np.flatnonzero(t < c)
    for lo in range(0, len(some), 2048):
        who = some[lo : lo + 2048]
        n, k = c[who].astype(float), t[who].astype(float)
        left = np.clip(np.exp(np.interp(np.log(k / n), place, m)), 1 / n, 1 - 1e-9)
        wide = n * (1 - d + left / (1 - left) - d * left**d / (1 - left**d)) * (1 - left) / left
        step = np.minimum(1, (1 - left) / np.sqrt(np.maximum(wide, 1e-300)) / left) / 4
        at = step[:, None] * np.arange(80)
        from_one = left[:, None] * (1 - 1j * at - at * at / 4)
        f = k[:, None] * np.log((1 - from_one**d) / d) - (n[:, None] + 1) * np.log1p(-from_one)
        most = f[:, 0].real
        value = (np.exp(f - most[:, None]) * (1j + at / 2)).imag
        area = (value.sum(1) - value[:, 0] / 2) * step * left / np.pi
        out[who] = log_gamma(n + 1) - log_gamma(k + 1) + most + np.log(np.maximum(area, 1e-300))
    return out


@functools.lru_cache(maxsize=8)
def _few_ratios(d: float) -> np.ndarray:
    """log S_d(c, t + 1) / S_d(c, t) for t from 1 to ``FEW`` - 1 (across), c from ``EXACT`` on in sixths of a power of e (down)."""
    c, t = np.repeat(EXACT * np.exp(np.arange(96) / 6), FEW), np.tile(np.arange(1, FEW + 1), 96)
    return np.diff(large_stirling(c, t, d).reshape(96, FEW), axis=1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by its series from 16 on."""
    x = np.asarray(x, float)
    up = np.where(x < 16, x + 16, x)
    down = np.log(np.where(x[..., None] < 16, x[..., None] + np.arange(16), 1.0)).sum(-1)
    return (up - 0.5) * np.log(up) - up + np.log(2 * np.pi) / 2 + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - down


def log_rise(start: float, step: float, n: np.ndarray) -> np.ndarray:
    """log of (start + step) (start + 2 step) ... (start + (n - 1) step)."""
    return (n - 1) * np.log(step) + log_gamma(start / step + n) - log_gamma(np.array(start / step + 1))


def _bisected(c: np.ndarray, rises) -> np.ndarray:
    """The m below 0 up to which ``rises(m)`` holds."""
    low, high = np.full(len(c), -800.0), np.full(len(c), -1e-12)
    for _ in range(64):
        m = (low + high) / 2
        up = rises(m)
        low, high = np.where(up, m, low), np.where(up, high, m)
    return low


def large_tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, theta: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """The same draw for many customers; where more than 64 tables are likely, by a normal distribution about the likeliest number."""

    def log_ratio(m: np.ndarray, c=c, p=p, others=others) -> tuple[np.ndarray, np.ndarray]:
        half, f = _saddle(m, c, d)
        t = np.maximum(half - 0.5, 1e-9)
        return t, f - np.log(t) + np.log(theta + d * (others + t)) + np.log(p)

    m = _bisected(c, lambda m: log_ratio(m)[1] > 0)  # of t beyond the likeliest, the ratio is below 1
    t, r = log_ratio(m)
    t_next, r_next = log_ratio(m + 1e-5 * np.abs(m))
    wide = np.sqrt(np.maximum((t_next - t) / np.maximum(r - r_next, 1e-300), 0))
    far = np.flatnonzero((t >= 64) & (t < c - 4))
    for _ in range(2):  # from there, Newton steps by the numbers themselves
        ratio = large_stirling(c[far], t[far] + 1, d) - large_stirling(c[far], t[far], d) + np.log(theta + d * (others[far] + t[far])) + np.log(p[far])
        t[far] = np.clip(t[far] + wide[far] ** 2 * ratio, 32, c[far] - 2)
    z = np.sqrt(-2 * np.log(np.maximum(uniform(key, sweep, 1), 1e-300))) * np.cos(2 * np.pi * uniform(key, sweep, 2))
    out = np.clip(np.rint(t + 0.5 + wide * z), 1, c).astype(np.int64)
    few = np.flatnonzero(t < 64)
    for lo in range(0, len(few), 2048):
        who = few[lo : lo + 2048]
        at = np.minimum(np.log(c[who] / EXACT) * 6, len(_few_ratios(d)) - 1.001)
        low, share = at.astype(np.int64), (at % 1)[:, None]
        ratio = (1 - share) * _few_ratios(d)[low] + share * _few_ratios(d)[low + 1]
        ratio += np.log(theta + d * (others[who][:, None] + np.arange(1, FEW))) + np.log(p[who])[:, None]
        weight = np.cumsum(np.concatenate([np.zeros((len(who), 1)), ratio], 1), 1)
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        out[who] = 1 + (uniform(key[who], sweep)[:, None] * weight[:, -1:] > weight).sum(1)
    return np.minimum(out, c)


def tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, theta: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """A draw of each dish's number of tables: c customers, parent's probability p, other dishes' tables in the restaurant."""
    t = np.minimum(c, 1)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    if len(some):
        stirling = _stirling(d)
        width = np.searchsorted(WIDTHS, c[some])
        order = np.argsort(width, kind="stable")
        some, width = some[order], width[order]
        at = runs(width)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(width)], strict=True):
            n = int(WIDTHS[width[a]])
            for lo in range(a, b, max(1, (1 << 17) // n)):
                who = some[lo : min(b, lo + max(1, (1 << 17) // n))]
                step = np.log(theta + d * (others[who][:, None] + np.arange(n))) + np.log(p[who])[:, None]
                weight = stirling[c[who], 1 : n + 1] + np.cumsum(step, 1)
                weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
                t[who] = np.minimum(1 + (uniform(key[who], sweep)[:, None] * weight[:, -1:] > weight).sum(1), c[who])
    many = np.flatnonzero(c > EXACT)
    if len(many):
        t[many] = large_tables(c[many], p[many], others[many], d, theta, key[many], sweep)
    return t


def share(c, t, total_c, total_t, d: float, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """A dish's probability in a restaurant as a + b times that of the restaurant above."""
    return np.maximum(c - d * t, 0) / (theta + total_c), (theta + d * total_t) / (theta + total_c)


def _place(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where the asked are among the known, which are sorted; their number if not."""
    if not len(known):
        return np.zeros(len(asked), np.int64)
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[place] == asked, place, len(known))


class Seats:
    """All restaurants of some contexts: dishes by pair of words (level 1, in ``mid``) and by word (level 0 here, in ``low``).

    group, far, dish, count: distinct (context word's group, word before it, word), and how often the training texts have
    it, which may be 0; p: the dish's probability in the root.
    """

    def __init__(self, group: np.ndarray, far: np.ndarray, dish: np.ndarray, count: np.ndarray, p: np.ndarray):
        pair, self.c = joint(group, far), count
        self.key = joint(pair, dish)
        self.pairs, _, self.of_pair = textvec.distinct(pair)
        self.lows, first, self.up = textvec.distinct(joint(group, dish))
        self.groups, _, self.of_group = textvec.distinct(group[first])
        self.p = p[first]
        self.t = np.minimum(count, 1)
        self.t_low = np.minimum(self.low_customers(), 1)
        self.total = np.bincount(self.of_pair, self.c, len(self.pairs))

    def low_customers(self) -> np.ndarray:
        return np.bincount(self.up, self.t, len(self.lows)).astype(np.int64)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables by pair, customers and tables by group."""
        return np.bincount(self.of_pair, self.t, len(self.pairs)), np.bincount(self.of_group, self.low_customers(), len(self.groups)), np.bincount(self.of_group, self.t_low, len(self.groups))

    def sweep(self, d: list[float], theta: list[float], number: int) -> None:
        c_low = self.low_customers()
        of_pair, c_group, t_group = self.totals()
        # Without the dish's own customers in the parent.
        left = c_low[self.up] - self.t
        stay = np.minimum(self.t_low[self.up], left)
        group = self.of_group[self.up]
        a, b = share(left, stay, c_group[group] - self.t, t_group[group] - (self.t_low[self.up] - stay), d[1], theta[1])
        self.t = tables(self.c, a + b * self.p[self.up], of_pair[self.of_pair] - self.t, d[0], theta[0], self.key, 2 * number)
        others = t_group[self.of_group] - self.t_low
        self.t_low = tables(self.low_customers(), self.p, others, d[1], theta[1], self.lows, 2 * number + 1)

    def mixture(self, d: list[float], theta: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Of all that was asked: a and b, of which the probability is a + b times that of the root."""
        of_pair, c_group, t_group = self.totals()
        a1, b1 = share(self.low_customers(), self.t_low, c_group[self.of_group], t_group[self.of_group], d[1], theta[1])
        a2, b2 = share(self.c, self.t, self.total[self.of_pair], of_pair[self.of_pair], d[0], theta[0])
        return a2 + b2 * a1[self.up], b2 * b1[self.up]

    def histograms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What discounts and strengths are told by: places and counts, of both levels customers and tables of restaurants, then of
        dishes; and the log likelihood, by level, discount and strength, of all that is larger."""
        out, more = [], np.zeros((2, len(DISCOUNTS), len(STRENGTHS)))
        of_pair, c_group, t_group = self.totals()
        for level, (c, t, at, customers, tabs) in enumerate(((self.c, self.t, self.of_pair, self.total, of_pair), (self.low_customers(), self.t_low, self.of_group, c_group, t_group))):
            small, dishes, large = customers <= LARGE, (c > 1) & (c <= EXACT), c > EXACT
            out += [np.bincount(customers[small].astype(np.int64), minlength=LARGE + 1), np.bincount(tabs[small].astype(np.int64), minlength=LARGE + 1), np.bincount(c[dishes] * (EXACT + 1) + t[dishes], minlength=(EXACT + 1) ** 2)]
            for x, dx in enumerate(DISCOUNTS.tolist()):
                if large.any():
                    more[level, x] += large_stirling(c[large], t[large], dx).sum()
                for y, ty in enumerate(STRENGTHS.tolist() if not small.all() else []):
                    more[level, x, y] += log_rise(ty, dx, tabs[~small]).sum() - log_rise(ty, 1.0, customers[~small]).sum()
        out = np.concatenate(out)
        place = np.flatnonzero(out)
        return place, out[place], more


def sampled(histogram: np.ndarray, rng: np.random.Generator, more: np.ndarray | None = None) -> tuple[list[float], list[float]]:
    """Discounts and strengths of both levels, drawn from their posterior on a grid, given seats; more: what larger ones add."""
    d, theta = [], []
    sizes = [LARGE + 1, LARGE + 1, (EXACT + 1) ** 2]
    i = np.arange(LARGE + 1)
    for number, level in enumerate(histogram.reshape(2, -1)):
        customers, tabs, dishes = np.split(level, np.cumsum(sizes)[:-1])
        loglik = np.zeros((len(DISCOUNTS), len(STRENGTHS))) if more is None else more[number].copy()
        used = np.flatnonzero(dishes)
        for x, dx in enumerate(DISCOUNTS):
            seated = (dishes[used] * _stirling(float(dx)).ravel()[used]).sum()
            for y, ty in enumerate(STRENGTHS):
                rise = lambda step, ty=ty: np.concatenate([[0, 0], np.cumsum(np.log(ty + step * i[1:-1]))])
                loglik[x, y] += seated + (tabs * rise(dx)).sum() - (customers * rise(1.0)).sum()
        weight = np.exp(loglik - loglik.max()).ravel().cumsum()
        x, y = np.divmod(int((weight < rng.random() * weight[-1]).sum()), len(STRENGTHS))
        d.append(float(DISCOUNTS[x]))
        theta.append(float(STRENGTHS[y]))
    return d, theta


# The root.


def _root(count: np.ndarray, key: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities in the root of words with so many customers there, averaged over the sweeps kept."""
    out, t = np.zeros(len(count)), np.minimum(count, 1)
    for number, total in enumerate(model["root_tables"]):
        a, b = share(count, t, model["root_customers"], total, model["root_discount"], 1.0)
        if number >= model["burn_in"]:
            out += (a + b * model["base"]) / (len(model["root_tables"]) - model["burn_in"])
        if number + 1 < len(model["root_tables"]) or model.get("next"):
            t = tables(count, np.full(len(count), model["base"]), np.maximum(total - t, 0), model["root_discount"], 1.0, key, 1000 + number)
    return t if model.get("next") else out


def train(learn: DataFrame, burn_in: int = 2, kept: int = 2) -> dict:
    """Counts of learn (text), and the root's seating: words (a stored table by bucket), N, V, and the most frequent words."""
    partitions = int(learn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words, path = _words(learn, partitions)

    def sums(f, names: list[str]) -> dict:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(names), np.int64)
            for batch in batches:
                for blob in batch.column(0):
                    total += np.array(f(*_unpacked(blob)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], names)

        out = words.select("blob").mapInArrow(rows, ", ".join(f"{x} long" for x in names)).agg(*(F.sum(x).alias(x) for x in names)).first()
        return {x: int(out[x] or 0) for x in names}

    s = sums(lambda key, count, n1: (count.sum(), len(key), n1.sum(), (n1 == 1).sum(), (n1 == 2).sum(), (count == 1).sum(), (count == 2).sum()), ["n", "v", "customers", "ones", "twos", "once", "twice"])
    guess = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a and b else 0.5
    model = {"n": s["n"], "v": s["v"], "words": words, "path": path, "partitions": partitions, "burn_in": burn_in, "kept": kept, "root_customers": s["customers"], "root_discount": guess(s["ones"], s["twos"]), "base": 1.0 / (s["v"] + 1), "discount": guess(s["once"], s["twice"])}
    totals = [s["v"]]
    for _ in range(burn_in + kept - 1):
        part = {k: model[k] for k in ("burn_in", "root_customers", "root_discount", "base")} | {"root_tables": list(totals), "next": True}
        totals.append(sums(lambda key, count, n1, part=part: (_root(n1, key, part).sum(),), ["t"])["t"])
    model["root_tables"] = totals
    return model | _top(words, model)


def _top(words: DataFrame, model: dict) -> dict:
    """The words that more often occur than any count that over ``TOP`` words exceed: hash, count and probability in the root,
    in order of hash, at most ``TOP``."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                c, n = np.unique(_unpacked(blob)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["c", "n"])

    # At most as many rows reach the driver as there are counts above the least that TOP words can have.
    by_count = words.select("blob").mapInArrow(sizes, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).limit(TOP + 1).collect()
    least, held = 0, 0
    for r in by_count:
        held += r["n"]
        if held > TOP:
            least = r["c"]
            break
    slim = {k: model[k] for k in ("burn_in", "root_customers", "root_discount", "base", "root_tables")}

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                key, count, n1 = _unpacked(blob)
                keep = count > least
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(count[keep]), pa.array(_root(n1[keep], key[keep], slim))], ["key", "c", "p"])

    table = words.select("blob").mapInArrow(frequent, "key long, c long, p double").toArrow()
    key, c, p = (table[x].to_numpy() for x in ("key", "c", "p"))
    key = key.view(np.uint64)
    order = np.argsort(key)
    key, c, p = key[order], c[order], p[order]
    return {"top": key, "top_count": c, "top_p": p}


class Top:
    """Places of the most frequent words, looked up by the upper bits of their hash first."""

    def __init__(self, model: dict):
        self.key, self.count = model["top"], model["top_count"]
        self.first = np.full(1 << 20, -1, np.int32)
        slot = (self.key >> _U(44)).astype(np.int64)
        self.first[slot[::-1]] = np.arange(len(slot))[::-1]
        self.several = np.bincount(slot, minlength=1 << 20) > 1
        limit = max(GROUP, model["n"] >> 16)
        self.groups = -(-self.count // limit)
        self.base = np.log10((self.count + 1) / (model["n"] + model["v"] + 1))

    def places(self, token: np.ndarray) -> np.ndarray:
        """Of each token its place, or ``RARE``."""
        if not len(self.key):
            return np.full(len(token), RARE, np.int64)
        slot = (token >> _U(44)).astype(np.int64)
        place = self.first[slot].astype(np.int64)
        hit = (place >= 0) & (self.key[place] == token)
        place[~hit] = RARE
        again = np.flatnonzero(~hit & self.several[slot])
        if len(again):
            found = _place(self.key, token[again])
            place[again] = np.where(found < len(self.key), found, RARE)
        return place


def _arrays(data: memoryview, *shapes: tuple[type, int]) -> list[np.ndarray]:
    """Arrays that lie one after another."""
    out, at = [], 0
    for kind, n in shapes:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def _head(*numbers: int) -> bytes:
    return np.array(numbers, np.int64).tobytes()


def _scored_tokens(batch: pa.RecordBatch, top: Top) -> Iterator[tuple]:
    """Of each chunk: rows, tokens, tokens of each text, their places among the frequent, groups of their contexts, and half a hash of the word before the context."""
    for chunk in textvec.chunks(batch.column(2)):
        token, lengths = tokens(chunk)
        one, two = before(token)
        place = top.places(token)
        end = top.places(np.array([textvec.END_TOKEN]))
        context = np.concatenate([end, place[:-1]])
        split = np.append(top.groups, np.ones(RARE + 1 - len(top.groups), np.int64))[context]
        far = (two >> _U(32)).astype(np.uint32)
        group = textvec.mix(one + np.where(split > 1, far % np.maximum(split, 1), 0).astype(np.uint64) * _STEP)
        yield slice(chunk.lo, chunk.hi), token, lengths, place, group, far


#: Kinds of rows between stages: a slice's texts; its repeated triples' texts; tokens; triples; tokens that were looked up; sums by text; values of triples; counts of looked up words by text; histogram.
TEXTS, TIMES, TOKENS, TRIPLES, LOOKED, SUMS, VALUES, KNOWN, HISTOGRAM = range(9)


class Slices:
    """Cuts the texts that a task reads into slices, in the same way whatever is read of them."""

    def __init__(self) -> None:
        self.part, self.count, self.size, self.docs = TaskContext.get().partitionId(), 0, 0, 0

    def numbers(self, lengths: np.ndarray, held_out: np.ndarray) -> np.ndarray:
        """Of the next texts' tokens the text's number in the slice, with the bit of training texts."""
        return np.repeat(np.arange(self.docs, self.docs + len(lengths), dtype=np.uint16) | np.where(held_out, np.uint16(0), LEARNED), lengths)

    def full(self, lengths: np.ndarray) -> bool:
        self.size, self.docs = self.size + int(lengths.sum()), self.docs + len(lengths)
        return self.size >= SLICE_TOKENS or self.docs + textvec.CHUNK_ROWS > SLICE_DOCS

    def ended(self) -> int:
        """The slice's id; the next one begins."""
        slice_id = (self.part << 32) + self.count
        self.count, self.size, self.docs = self.count + 1, 0, 0
        return slice_id


def _looked(docs: DataFrame, top, model: dict, passes: int, partitions: int) -> DataFrame:
    """pass, bucket, blob: of all tokens beyond the most frequent words, their words' counts and probabilities in the root."""
    slim = {k: model[k] for k in ("burn_in", "root_customers", "root_discount", "base", "root_tables")}

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Top = worker_keeps(("top", id(top)), lambda: Top(top.value))
        slices, held = Slices(), []

        def flush() -> Iterator[pa.RecordBatch]:
            whole, group, far, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(whole)
            whole, group, far, doc = whole[order], group[order], far[order], doc[order]
            cuts = _cuts(_bucket(whole, partitions))
            blobs = [_head(b - a) + whole[a:b].tobytes() + group[a:b].tobytes() + far[a:b].tobytes() + doc[a:b].tobytes() for _, a, b in cuts]
            yield from _batches(blobs, bucket=np.array([x[0] for x in cuts], np.int32), slice=np.full(len(cuts), slices.ended()))

        for batch in batches:
            held_out = batch.column(3).to_numpy(zero_copy_only=False)
            for at, token, lengths, place, group, far in _scored_tokens(batch, t):
                rare = place == RARE
                held.append((token[rare], group[rare], far[rare], slices.numbers(lengths, held_out[at])[rare]))
                if slices.full(lengths):
                    yield from flush()
        if held:
            yield from flush()
        tidy()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps(None)
        none = _root(np.zeros(1, np.int64), np.zeros(1, np.uint64), slim)
        for _, received in _by_bucket(batches):
            key, count, p, held, size = np.zeros(0, np.uint64), np.zeros(1, np.int64), none, [], 0

            def flush(held: list, key: np.ndarray, count: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
                names = np.array([x[0] for x in held], np.int64)
                slices = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[1]) for x in held])
                whole, group, far, doc = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
                to = ((group & _U(0xFFFFFFFF)) % _U(passes)).astype(np.int64) * partitions + _bucket(group, partitions)
                order = np.argsort(to, kind="stable")
                whole, group, far, doc, slices, to = whole[order], group[order], far[order], doc[order], slices[order], to[order]
                place = _place(key, whole)
                chance, times = p[place], count[place].astype(np.uint32)
                cuts = _cuts(to)
                blobs = []
                for _, a, b in cuts:
                    own, of = np.unique(slices[a:b], return_inverse=True)
                    blobs.append(_head(b - a, len(own)) + whole[a:b].tobytes() + group[a:b].tobytes() + chance[a:b].tobytes() + names[own].tobytes() + far[a:b].tobytes() + times[a:b].tobytes() + of.astype(np.uint32).tobytes() + doc[a:b].tobytes())
                number, bucket = np.divmod(np.array([x[0] for x in cuts], np.int64), partitions)
                yield from _batches(blobs, **{"pass": number.astype(np.int32), "bucket": bucket.astype(np.int32)})

            for slice_id, blob in received:  # the bucket's words come first
                data = memoryview(blob.as_buffer())
                if slice_id.as_py() < 0:
                    key, count, n1 = _unpacked(blob)
                    count, p = np.append(count, 0), np.append(_root(n1, key, slim), none)
                    continue
                (m,) = np.frombuffer(data[:8], np.int64).tolist()
                held.append((slice_id.as_py(), *_arrays(data[8:], (np.uint64, m), (np.uint64, m), (np.uint32, m), (np.uint16, m))))
                size += m
                if size >= LOOKED_TOKENS:
                    yield from flush(held, key, count, p)
                    held, size = [], 0
            if held:
                yield from flush(held, key, count, p)
        tidy()

    all_ = docs.mapInArrow(asked, "bucket int, slice long, blob binary").unionByName(model["words"].select("bucket", F.lit(-1).cast("long").alias("slice"), "blob"))
    return all_.repartition(partitions, "bucket").sortWithinPartitions("bucket", "slice").mapInArrow(met, "pass int, bucket int, blob binary")


def _asked(docs: DataFrame, top, number: int, passes: int, partitions: int) -> DataFrame:
    """bucket, slice, kind, blob: of each slice of docs (doc_id, no_id, text, held_out) what the pass asks of contexts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Top = worker_keeps(("top", id(top)), lambda: Top(top.value))
        slices, held, facts = Slices(), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            group, far, place, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            slice_id = slices.ended()
            order = np.argsort((group & ~_U(0xFFFFF)) | (joint(far.astype(np.uint64), place) & _U(0xFFFFF)))
            group, far, place, doc = group[order], far[order], place[order], doc[order]
            at = runs(group, far, place)
            often = np.diff(np.append(at, len(group)))
            crowd = often >= CROWD
            in_crowd = np.repeat(crowd, often)
            out: list[tuple[int, int, bytes]] = []
            g, f, p, n = group[~in_crowd], far[~in_crowd], place[~in_crowd], doc[~in_crowd]
            for bucket, a, b in _cuts(_bucket(g, partitions)):
                first = runs(g[a:b])
                out.append((bucket, TOKENS, _head(len(first), b - a) + g[a:b][first].tobytes() + first.astype(np.uint32).tobytes() + f[a:b].tobytes() + p[a:b].astype(np.uint16).tobytes() + n[a:b].tobytes()))
            if crowd.any():
                top_at = at[crowd]
                learned = np.add.reduceat(doc[in_crowd] >> 15, np.cumsum(often[crowd]) - often[crowd]).astype(np.uint32)
                g, f, p = group[top_at], far[top_at], place[top_at]
                for bucket, a, b in _cuts(_bucket(g, partitions)):
                    out.append((bucket, TRIPLES, _head(b - a) + g[a:b].tobytes() + f[a:b].tobytes() + learned[a:b].tobytes() + np.arange(a, b, dtype=np.uint32).tobytes() + p[a:b].astype(np.uint16).tobytes()))
                n = doc[in_crowd] & ~LEARNED
                out.append((slice_id % partitions, TIMES, _head(len(n)) + np.repeat(np.arange(len(top_at), dtype=np.uint32), often[crowd]).tobytes() + n.tobytes()))
            if number == 0:
                ids, null, held_out, lengths, base, known = (np.concatenate(x) for x in zip(*facts, strict=True))
                out.append((slice_id % partitions, TEXTS, _head(len(ids)) + ids.astype(np.int64).tobytes() + lengths.astype(np.int64).tobytes() + known.astype(np.int64).tobytes() + base.tobytes() + null.astype(np.uint8).tobytes() + held_out.astype(np.uint8).tobytes()))
            held.clear()
            facts.clear()
            yield from _batches([x[2] for x in out], bucket=np.array([x[0] for x in out], np.int32), slice=np.full(len(out), slice_id), kind=np.array([x[1] for x in out], np.int32))

        for batch in batches:
            ids, null, held_out = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            for at, token, lengths, place, group, far in _scored_tokens(batch, t):
                often = place != RARE
                now = ((group & _U(0xFFFFFFFF)) % _U(passes) == number) & often
                held.append((group[now], far[now], place[now], slices.numbers(lengths, held_out[at])[now]))
                if number == 0:
                    row = np.repeat(np.arange(len(lengths)), lengths)
                    facts.append((ids[at], null[at], held_out[at], lengths, np.bincount(row[often], t.base[place[often]] if len(t.base) else None, len(lengths)).astype(float), np.bincount(row[often], minlength=len(lengths))))
                if slices.full(lengths):
                    yield from flush()
        if held:
            yield from flush()
        tidy()

    return docs.mapInArrow(rows, "bucket int, slice long, kind int, blob binary")


def _answered(asked: DataFrame, top, settings: dict, partitions: int) -> DataFrame:
    """slice, kind, blob: the contexts' seating, and what it answers to slices."""
    d, theta, burn_in, kept = (settings[x] for x in ("d", "theta", "burn_in", "kept"))

    def seated(group: np.ndarray, far: np.ndarray, dish: np.ndarray, p: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Of all that is asked of some contexts: its logarithms, and the histograms of the contexts' restaurants."""
        _, one, which = textvec.distinct(joint(joint(group, far), dish))
        seats, p = Seats(group[one], far[one], dish[one], np.bincount(which, count, len(one)).astype(np.int64), p[one]), p[one]
        a, b = np.zeros(len(one)), np.zeros(len(one))
        for k in range(burn_in + kept):
            seats.sweep(d, theta, k)
            if k >= burn_in:
                x, y = seats.mixture(d, theta)
                a, b = a + x / kept, b + y / kept
        return np.log10(a + b * p)[which], seats.histograms()

    def valued(tok: list, tri: list, seen: list, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logarithms of all that a bucket is asked, and its histograms; its contexts are seated some shelves at a time."""
        sizes = [*(len(x[-1]) for x in tok), *(len(x[-1]) for x in tri), *(len(x[-1]) for x in seen)]
        frequent = sum(sizes[: len(tok) + len(tri)])
        group, far, count = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.uint32), np.empty(sum(sizes), np.uint32)
        place = np.empty(frequent, np.uint16)
        at = 0
        for i, (x, size) in enumerate(zip((*tok, *tri, *seen), sizes, strict=True)):
            to = slice(at, at + size)
            if i < len(tok):
                _, groups, first, far[to], place[to], doc = x
                group[to], count[to] = np.repeat(groups, np.diff(first)), doc >> 15
            elif i < len(tok) + len(tri):
                _, group[to], far[to], count[to], _, place[to] = x
            else:
                _, group[to], far[to], _, _, _, doc = x
                count[to] = doc >> 15
            at += size
        whole, p = (np.concatenate([np.zeros(0, kind), *(x[i] for x in seen)]) for i, kind in ((3, np.uint64), (4, np.float64)))
        shelf = _shelf(group, partitions)
        held = np.bincount(shelf, minlength=SHELVES)
        order = np.argsort(shelf, kind="stable").astype(np.uint32)
        del shelf
        ends = np.cumsum(held)
        starts = runs((ends - held) // PART)
        value, histogram, more = np.empty(len(group)), np.zeros(2 * (2 * (LARGE + 1) + (EXACT + 1) ** 2), np.int64), 0.0
        for a, b in zip((ends - held)[starts].tolist(), [*(ends - held)[starts[1:]].tolist(), len(group)], strict=True):
            if a == b:
                continue
            of = order[a:b]
            rare = of >= frequent
            dish, chance = np.empty(b - a, np.uint64), np.empty(b - a)
            dish[~rare], dish[rare] = place[of[~rare]], whole[of[rare] - frequent] | _U(1 << 63)
            chance[~rare], chance[rare] = root[place[of[~rare]]], p[of[rare] - frequent]
            value[of], (index, n, larger) = seated(group[of], far[of], dish, chance, count[of].astype(np.int64))
            histogram[index] += n
            more = more + larger
        return value, histogram, more

    def answers(received: list) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bytes]] = []
        tok, tri, seen = [], [], []
        for slice_id, kind, blob in received:
            kind, slice_id = kind.as_py(), slice_id.as_py()
            if kind in (TEXTS, TIMES):
                out.append((slice_id, kind, blob.as_py()))
                continue
            data = memoryview(blob.as_buffer())
            if kind == TOKENS:
                k, n = np.frombuffer(data[:16], np.int64).tolist()
                group, first, *rest = _arrays(data[16:], (np.uint64, k), (np.uint32, k), (np.uint32, n), (np.uint16, n), (np.uint16, n))
                tok.append((slice_id, group, np.append(first, n).astype(np.int64), *rest))
            elif kind == TRIPLES:
                (n,) = np.frombuffer(data[:8], np.int64).tolist()
                tri.append((slice_id, *_arrays(data[8:], (np.uint64, n), (np.uint32, n), (np.uint32, n), (np.uint32, n), (np.uint16, n))))
            else:
                n, k = np.frombuffer(data[:16], np.int64).tolist()
                whole, group, p, names, far, times, of, doc = _arrays(data[16:], (np.uint64, n), (np.uint64, n), (np.float64, n), (np.int64, k), (np.uint32, n), (np.uint32, n), (np.uint32, n), (np.uint16, n))
                seen.append((names[of], group, far, whole, p, times, doc))
        if tok or tri or seen:
            value, histogram, more = valued(tok, tri, seen, top.value["top_p"])
            at = 0

            def summed(slice_id: int, doc: np.ndarray, value: np.ndarray, kind: int = SUMS, times: np.ndarray | None = None) -> None:
                texts = np.flatnonzero(np.bincount(doc))
                more = b"" if times is None else np.bincount(doc, times > 0)[texts].astype(np.int64).tobytes()
                out.append((slice_id, kind, _head(len(texts)) + np.bincount(doc, value)[texts].tobytes() + more + texts.astype(np.uint16).tobytes()))

            for slice_id, *_, doc in tok:
                summed(slice_id, doc & ~LEARNED, value[at : at + len(doc)])
                at += len(doc)
            for slice_id, _, _, _, index, _ in tri:
                n = len(index)
                out.append((slice_id, VALUES, _head(n) + value[at : at + n].tobytes() + index.tobytes()))
                at += n
            if seen:
                slices, times, doc = (np.concatenate([x[i] for x in seen]) for i in (0, 5, 6))
                order = np.argsort(slices, kind="stable")
                doc, slices, times, rare = doc[order] & ~LEARNED, slices[order], times[order], value[at:][order]
                base = np.log10((times.astype(np.int64) + 1) / (top.value["n"] + top.value["v"] + 1))
                starts = runs(slices).tolist()
                for i, j in zip(starts, [*starts[1:], len(slices)], strict=True):
                    summed(int(slices[i]), doc[i:j], rare[i:j])
                    summed(int(slices[i]), doc[i:j], base[i:j], KNOWN, times[i:j])
            index = np.flatnonzero(histogram)
            out.append((-1, HISTOGRAM, _head(len(index)) + index.astype(np.int64).tobytes() + histogram[index].tobytes() + more.tobytes()))
        yield from _batches([x[2] for x in out], slice=np.array([x[0] for x in out], np.int64), kind=np.array([x[1] for x in out], np.int32))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps(None)
        for _, received in _by_bucket(batches):
            yield from answers(received)
        tidy()

    dealt = asked.repartition(partitions, "bucket").sortWithinPartitions("bucket", "slice", "kind")
    return dealt.mapInArrow(rows, "slice long, kind int, blob binary")


def _histogram(answered: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the pass, at most as many numbers as a histogram has places, and the log likelihood of all that is larger."""
    shape = (2, len(DISCOUNTS), len(STRENGTHS))
    places, values = 2 * (2 * (LARGE + 1) + (EXACT + 1) ** 2), int(np.prod(shape))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                data = memoryview(blob.as_buffer())
                (n,) = np.frombuffer(data[:8], np.int64).tolist()
                place, count, more = _arrays(data[8:], (np.int64, n), (np.int64, n), (np.float64, values))
                place, count = np.append(place, np.arange(places, places + values)), np.append(count.astype(float), more)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(count)], ["place", "n"])

    out = np.zeros(places + values)
    table = answered.where(F.col("kind") == HISTOGRAM).select("blob").mapInArrow(rows, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out[table["place"].to_numpy()] = table["n"].to_numpy()
    return out[:places].astype(np.int64), out[places:].reshape(shape)


def _finished(answered: DataFrame, model: dict, partitions: int) -> DataFrame:
    """The scores: all of a slice comes together."""
    n = model["n"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, received in _by_bucket(batches):
            values: dict[int, list] = {}
            waiting = []
            for kind, number, blob in received:  # texts come first; a pass's triples are told apart by its number
                data, kind, number = memoryview(blob.as_buffer()), kind.as_py(), number.as_py()
                (m,) = np.frombuffer(data[:8], np.int64).tolist()
                if kind == TEXTS:
                    ids, lengths, known, base, null, held_out = _arrays(data[8:], *((np.int64, m),) * 3, (np.float64, m), (np.uint8, m), (np.uint8, m))
                    known, base, score = known.copy(), base.copy(), np.zeros(m)
                elif kind == TIMES:
                    waiting.append((number, *_arrays(data[8:], (np.uint32, m), (np.uint16, m))))
                elif kind == SUMS:
                    sums, doc = _arrays(data[8:], (np.float64, m), (np.uint16, m))
                    score[doc] += sums
                elif kind == VALUES:
                    values.setdefault(number, []).append(_arrays(data[8:], (np.float64, m), (np.uint32, m)))
                else:  # of words beyond the most frequent ones
                    sums, times, doc = _arrays(data[8:], (np.float64, m), (np.int64, m), (np.uint16, m))
                    base[doc] += sums
                    known[doc] += times
            for number, index, doc in waiting:
                value, at = (np.concatenate(x) for x in zip(*values[number], strict=True))
                score += np.bincount(doc, value[np.argsort(at)][index], len(score))
            arrays = [pa.array(ids, mask=null.astype(bool)), pa.array(held_out.astype(bool)), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        tidy()

    all_ = answered.where(F.col("kind") != HISTOGRAM).select("slice", "kind", "pass", "blob")
    out = all_.repartition(partitions, "slice").sortWithinPartitions("slice", "kind", "pass").mapInArrow(texts, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return stored_at(out, "scores", size=BATCH_BYTES)[0]


def scored(docs: DataFrame, model: dict, held_out: Column, passes: int = 3, seed: int = 23) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text).

    The texts that aren't held out are those that ``model`` was trained on; contexts are seated from them here.
    """
    spark, partitions = docs.sparkSession, model["partitions"]
    top = spark.sparkContext.broadcast({k: model[k] for k in ("top", "top_count", "top_p", "n", "v")})
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text", held_out.alias("held_out"))
    rng = np.random.default_rng(seed)
    settings = {"d": [model["discount"]] * 2, "theta": [1.0, 1.0], "burn_in": model["burn_in"], "kept": model["kept"]}
    told, more, parts, paths = 0, 0, [], []
    looked, path = stored_at(_looked(rows, top, model, passes, partitions), "looked", rows=64, size=BATCH_BYTES)
    paths.append(path)
    for number in range(passes):
        now = looked.where(F.col("pass") == number).select("bucket", F.lit(-1).cast("long").alias("slice"), F.lit(LOOKED).alias("kind"), "blob")
        part, path = stored_at(_answered(_asked(rows, top, number, passes, partitions).unionByName(now), top, settings, partitions), "answers", rows=64, size=BATCH_BYTES)
        parts.append(part.withColumn("pass", F.lit(number)))
        paths.append(path)
        if number + 1 < passes:
            told, more = (x + y for x, y in zip((told, more), _histogram(part), strict=True))
            settings["d"], settings["theta"] = sampled(told, rng, more)
    out = _finished(functools.reduce(DataFrame.unionByName, parts), model, partitions)
    for path in paths:
        discard(spark, path)
    return out
