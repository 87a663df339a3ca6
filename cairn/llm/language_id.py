"""Operator 1: language identification by nearest centroid.

A text is the vector of its byte 2- and 3-grams, hashed (ASCII other than letters is a blank, grams with two adjacent blanks
don't count), with log term counts times inverse document frequencies, at
length 1. Each language has several centroids, found by spherical k-means over a bounded sample; a text gets the language
of the centroid with the largest cosine. It is rejected where that cosine falls below what the language's own sample
reaches (``quantile`` of it, less a margin): ``rejected`` says so beside the nearest language.

Rows: a null text and one without a letter get ``und`` and score 0; so does every text if nothing was learned. A-Z count
as a-z. Texts are whole; repeated rows are predicted each; ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import tidy

BITS = 12
WIDTH = 2 << BITS
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[:128] = 0x20
_LOWER[ord("a") : ord("z") + 1] = _LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER = np.zeros(256, np.int8)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1


def counts(chunk: textvec.Chunk) -> np.ndarray:
    """Texts x features: log counts of hashed byte 2-grams and 3-grams."""
    n, at = len(chunk.at) - 1, chunk.at
    data = _LOWER[chunk.data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    blank = data == 0x20
    twice = blank[1:] & blank[:-1]
    cells = [np.zeros(0, np.int64)]
    for k in (2, 3):
        if len(data) < k:
            continue
        gram = data[: len(data) - k + 1].copy()
        for j in range(1, k):
            gram |= data[j : len(data) - k + 1 + j] << np.uint32(8 * j)
        gram = ((gram + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        first = row[: len(gram)]
        good = (first == row[k - 1 :]) & ~twice[: len(gram)]
        if k == 3:
            good &= ~twice[1:]
        cells.append((first * np.int64(WIDTH) + gram + ((k - 2) << BITS))[good])
    return np.log1p(np.bincount(np.concatenate(cells), minlength=n * WIDTH).astype(np.float32)).reshape(n, WIDTH)


def lettered(chunk: textvec.Chunk) -> np.ndarray:
    """Whether each text has a letter of any script."""
    upto = np.concatenate([[0], np.cumsum(_LETTER[chunk.data], dtype=np.int64)])
    out = upto[chunk.at[1:]] > upto[chunk.at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(chunk.at) > 0)):
        out[i] = any(map(str.isalpha, chunk.text(chunk.at[i], chunk.at[i + 1])))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def clustered(x: np.ndarray, k: int, seed: int = 5, rounds: int = 15) -> np.ndarray:
    """Spherical k-means of unit rows: at most k centroids."""
    centre = x[[0]]
    for _ in range(min(k, len(x)) - 1):  # farthest of a few candidates
        near = (x @ centre.T).max(1)
        centre = np.concatenate([centre, x[[int(np.argsort(near, kind="stable")[len(x) // 50])]]])
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        centre = np.stack([unit(x[own == j].sum(0, keepdims=True))[0] if (own == j).any() else centre[j] for j in range(len(centre))])
    return centre


def train(docs: DataFrame, per_language: int = 1500, total: int = 12_000, k: int = 4, quantile: float = 0.01, margin: float = 0.2) -> dict:
    """Learns from docs (doc_id, text, lang). The sample, at most ``total`` rows, is all that reaches the driver.

    Of each language ``per_language`` rows at most are taken, or its share of ``total``: those of the smallest hashes of the id,
    of rows that repeat an id those of the smallest hashes of the text. Rows are cut by rank in the tasks before they are collected.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min(slot).alias("least")).collect()}
    if not sizes:
        return {"langs": []}
    each = max(1, min(per_language, total // len(sizes)))
    limit = F.create_map(*(F.lit(y) for lang, (n, least) in sizes.items() for y in (lang, max(least + 1, min(1 << 30, int((1 << 30) * 1.1 * each / n) + 1)))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textvec.chunks(batch.column(0)):
                x = counts(chunk)
                row, feature = np.nonzero(x)
                ends = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (feature.astype(np.int32), x[row, feature])]
                yield pa.RecordBatch.from_arrays([*lists, *(c.slice(chunk.lo, len(x)) for c in batch.columns[1:])], ["feature", "value", "lang", "slot", "tie"])

    near = known.withColumns({"slot": slot, "tie": F.xxhash64("text")}).where(F.col("slot") < limit[F.col("lang")])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("slot", "tie"))
    featured = near.select("text", "lang", "slot", "tie").mapInArrow(rows, "feature array<int>, value array<float>, lang string, slot long, tie long")
    table = featured.withColumn("rank", first).where(F.col("rank") <= each).drop("rank", "tie").toArrow()
    table = table.sort_by([("slot", "ascending")])
    lang = np.array(table["lang"].to_pylist(), object)
    feature, value = table["feature"], table["value"]
    langs = sorted(set(lang.tolist()))
    keep = np.concatenate([np.flatnonzero(lang == x)[:each] for x in langs]) if langs else np.zeros(0, int)
    df = np.zeros(WIDTH)
    for i in keep:
        df[feature[i].values.to_numpy()] += 1
    idf = (np.log((1 + len(keep)) / (1 + df)) + 1).astype(np.float32)
    centres, owner, floor = [], [], []
    for at, x in enumerate(langs):
        mine = [i for i in keep if lang[i] == x]
        dense = np.zeros((len(mine), WIDTH), np.float32)
        for r, i in enumerate(mine):
            dense[r, feature[i].values.to_numpy()] = value[i].values.to_numpy()
        dense = unit(dense * idf)
        centre = clustered(dense, k)
        floor.append(float(np.quantile((dense @ centre.T).max(1), quantile)) - margin)
        centres.append(centre)
        owner += [at] * len(centre)
    del table, feature, value
    tidy()
    return {"langs": langs, "idf": idf, "centres": np.concatenate(centres).astype(np.float32) if centres else np.zeros((0, WIDTH), np.float32), "owner": np.array(owner, int), "floor": np.array(floor)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 to 1), rejected; one pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        langs = np.array([*m["langs"], UNKNOWN], object)
        for batch in batches:
            for chunk in textvec.chunks(batch.column(1)):
                known = lettered(chunk)
                if m["langs"]:
                    cosine = unit(counts(chunk) * m["idf"]) @ m["centres"].T
                    best = cosine.argmax(1)
                    lang, score = m["owner"][best], np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
                    rejected = score < m["floor"][lang]
                else:
                    lang, score = np.zeros(len(known), int), np.zeros(len(known))
                    known = np.zeros(len(known), bool)
                    rejected = ~known
                lang, score = np.where(known, lang, -1), np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(known)), pa.array(langs[lang], pa.string()), pa.array(score), pa.array(rejected | ~known)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, lang_pred string, score double, rejected boolean")
