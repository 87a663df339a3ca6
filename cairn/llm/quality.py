"""Operator 9: a quality classifier, Naive Bayes support vectors.

Features of a text are indicators of byte 3-grams and of shape 2-grams (a word's shape: its case, how it ends, its length,
whether it repeats the word before). Each is scaled by its log-count ratio between the classes; a linear hinge-loss model
over the scaled, length-normalised indicators is fitted by dual coordinate descent and interpolated with the
mean magnitude of its weights; margins become probabilities by a logistic curve fitted on a part of the sample that the model has not seen.

The classifier is fitted on the ``sample`` labelled rows with the smallest hashes of their id, at most. Rows: a null or
empty text has no features and gets the score of the bias alone. Repeated rows are scored each; several labels of one
document count by their mean, halves as 1. Without labels every score is 0.5, with labels of one class the share of 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import free_name, tidy, worker_keeps

GRAM_BITS = 15
SHAPES = 64
WIDTH = (1 << GRAM_BITS) + SHAPES * SHAPES
_KIND = np.full(256, 3, np.int64)
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = 0
_KIND[[*range(ord("0"), ord("9") + 1)]] = 1
_KIND[[ord(c) for c in ".,;:?'\")"]] = 2
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True


def marks(chunk: textvec.Chunk) -> np.ndarray:
    """Texts x features: whether the text has the feature."""
    n, data, at = len(chunk.at) - 1, chunk.data, chunk.at
    out = np.zeros((n, WIDTH), bool)
    if len(data) >= 3:
        row = np.repeat(np.arange(n), np.diff(at))
        wide = data.astype(np.uint32)
        gram = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
        whole = row[:-2] == row[2:]
        out[row[:-2][whole], gram[whole]] = True
    w = textvec.words(chunk, lower=False)
    if len(w.hash):
        row = np.repeat(np.arange(n), np.diff(w.of))
        upper, lower = (np.concatenate([[0], np.cumsum(x[data], dtype=np.int32)]) for x in (_UPPER, _LOWER))
        ups, lows = upper[w.end] - upper[w.start], lower[w.end] - lower[w.start]
        case = np.where(ups == 0, 0, np.where((lows == 0) & (ups > 1), 2, 1))
        again = np.zeros(len(row), np.int64)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        size = np.minimum((w.end - w.start) // 12, 1)
        shape = np.minimum(case, 1) + 2 * (case == 2) + 4 * _KIND[data[w.end - 1]] + 16 * again + 32 * size
        same = row[1:] == row[:-1]
        out[row[1:][same], (1 << GRAM_BITS) + shape[:-1][same] * SHAPES + shape[1:][same]] = True
    return out


def fit(features: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, beta: float = 0.25, seed: int = 7) -> dict:
    """The model of sparse indicator lists: weights of features, their log-count ratios, bias and logistic curve."""
    labels = np.asarray(labels, np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    model = {"weight": np.zeros(WIDTH), "ratio": np.zeros(WIDTH), "bias": 0.0, "slope": 0.0, "shift": float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))}
    if len(set(labels.tolist())) < 2:
        return model | {"shift": np.clip(model["shift"], -20, 20)}
    order = np.random.default_rng(seed).permutation(len(labels))
    held = order[: len(order) // 5] if len(order) >= 50 else order
    rest = order[len(order) // 5 :] if len(order) >= 50 else order
    count = np.ones((2, WIDTH))
    for i in rest:
        count[labels[i], features[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    norms = np.array([np.sqrt((ratio[f] ** 2).sum()) or 1.0 for f in features])
    sign = 2.0 * labels - 1
    weight, alpha, bias = np.zeros(WIDTH), np.zeros(len(labels)), 0.0
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for i in rng.permutation(rest):
            f = features[i]
            x = ratio[f] / norms[i]
            gradient = sign[i] * (weight[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weight[f] += step * x
                bias += step
                alpha[i] = new
    weight = (1 - beta) * np.abs(weight).mean() + beta * weight  # towards Naive Bayes itself
    margins = np.array([(weight[features[i]] @ ratio[features[i]]) / norms[i] + beta * bias for i in held])
    y = labels[held]
    slope, shift = 1.0 / max(margins.std(), 1e-9), 0.0
    if len(set(y.tolist())) == 2:
        for _ in range(60):  # Newton steps on the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
            g = np.array([((p - y) * margins).sum() + 1e-3 * slope, (p - y).sum()])
            v = p * (1 - p)
            h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
            slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return {"weight": weight, "ratio": ratio, "bias": beta * bias, "slope": float(slope), "shift": float(shift)}


def score(model: dict, chunk: textvec.Chunk) -> np.ndarray:
    """The probability of class 1 of each text."""
    row, feature = np.nonzero(marks(chunk))
    n = len(chunk.at) - 1
    ratio = model["ratio"][feature]
    norm = np.sqrt(np.bincount(row, ratio * ratio, n))
    margin = np.bincount(row, model["weight"][feature] * ratio, n) / np.where(norm > 0, norm, 1) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["shift"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> dict:
    """Fits on documents (doc_id, text) with labels (doc_id, quality); ``sample`` bounds the rows, sent to the driver."""
    mean = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    chosen = mean.select("doc_id", (F.col("q") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textvec.chunks(batch.column(0)):
                row, feature = np.nonzero(marks(chunk))
                ends = np.searchsorted(row, np.arange(chunk.hi - chunk.lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(chunk.lo, chunk.hi - chunk.lo)], ["features", "y"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").limit(sample)
    table = texts.mapInArrow(rows, "features array<int>, y int").toArrow()
    lists = table["features"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
    ends = ends - ends[0]
    model = fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], table["y"].to_numpy())
    del table, lists, flat
    tidy()
    return model


def scored(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` with the score in a further column, the last one, in one pass without a shuffle.

    Its name is ``column``, with underscores after it if docs has such a column already, which is kept.
    """
    held, column = docs.sparkSession.sparkContext.broadcast(model), free_name(docs.columns, column)
    schema = docs.withColumn(column, F.lit(0.0)).schema
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps(None)
        for batch in batches:
            for chunk in textvec.chunks(batch.column(at)):
                part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(held.value, chunk))], schema.names)
        tidy()

    return docs.mapInArrow(rows, schema)
