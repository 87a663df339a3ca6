"""Annotated matrices in two shapes - rows of arrays and long rows of entries - and the transforms of their values.

Long rows are (cell, state, stage, gene, v). Arithmetic is in doubles; arrays are transformed in place by higher-order
functions, so that no shuffle is needed for what concerns one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_long(cells: DataFrame, x: str = "x", keys: tuple[str, ...] = ("cell", "state", "stage")) -> DataFrame:
    """One row for each entry; genes are numbered from 1."""
    return cells.select(*keys, F.posexplode(x).alias("at", "v")).select(*keys, (F.col("at") + 1).cast("long").alias("gene"), "v")


def to_wide(entries: DataFrame, keys: tuple[str, ...] = ("cell", "state", "stage")) -> DataFrame:
    """Arrays in order of gene, the inverse of ``to_long``."""
    rows = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("gene", "v"))).alias("r"))
    return rows.select(*keys, F.transform("r", lambda r: r["v"]).alias("x"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def log_cp10k(x: Column) -> Column:
    """log1p of counts scaled to 10,000 a row; null for a row without mass."""
    mass = total(x)
    return F.when(mass > 0, F.transform(x, lambda v: F.log1p(v * 1e4 / mass)))


def restore_cp10k(x: Column) -> Column:
    """Log rows brought back to closed units: expm1, rescaled to 10,000, log1p."""
    return log_cp10k(F.transform(x, lambda v: F.expm1(v)))


def to_library(x: Column, library: Column) -> Column:
    """Log rows renormalised to a target library; logs are clipped to 0..50 first."""
    counts = F.transform(x, lambda v: F.expm1(F.least(F.greatest(v, F.lit(0.0)), F.lit(50.0))))
    mass = total(counts)
    return F.transform(counts, lambda v: F.log1p(F.when(mass > 0, v * library / mass).otherwise(v)))


def is_closed(x: Column, rtol: float = 1e-5, atol: float = 0.02) -> Column:
    """Whether the counts of a log row sum to 10,000."""
    return F.abs(total(F.transform(x, lambda v: F.expm1(v))) - 1e4) <= atol + rtol * 1e4


def library_scaled(x: Column, target: Column) -> Column:
    """Rows scaled to a target sum; rows without mass stay; negatives become 0."""
    mass = total(x)
    return F.transform(x, lambda v: F.greatest(F.when(mass > 0, v * target / mass).otherwise(v), F.lit(0.0)))


def unit_rows(x: Column) -> Column:
    """Rows at length 1; a zero row stays zero."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / F.when(norm > 0, norm).otherwise(1.0))


def rate_decoded(v: Column, rate: Column) -> Column:
    """log1p(expm1(v) * exp(rate)); exactly v where the rate is 0."""
    return F.when(rate == 0, v).otherwise(F.log1p(F.expm1(v) * F.exp(rate)))


def bounded_add(v: Column, delta: Column, limit: float = 0.6931471805599453) -> Column:
    """Adds a clipped delta; a negative one shrinks counts instead."""
    step = F.least(F.greatest(delta, F.lit(-limit)), F.lit(limit))
    return F.when(step >= 0, v + step).otherwise(F.log1p(F.expm1(v) * F.exp(step)))


def non_negative(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def shrink_weight(delta: Column, se: Column, c: float) -> Column:
    """t / (t + c) of t = abs(delta / se); 0 without a positive se; with c = 0 a step."""
    t = F.abs(delta / se)
    return F.when((se <= 0) | se.isNull(), 0.0).when(F.lit(c == 0), F.when(t > 0, 1.0).otherwise(0.0)).otherwise(t / (t + F.lit(float(c))))


def standard_error(var_a: Column, n_a: Column, var_b: Column, n_b: Column) -> Column:
    return F.sqrt(var_a / n_a + var_b / n_b)


def variance_shrunk(delta: Column, var: Column) -> Column:
    return F.when(delta * delta + var > 0, delta * delta * delta / (delta * delta + var)).otherwise(0.0)


def z_scored(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """Standardised within groups by population moments; a spread of 0 counts as 1."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd).otherwise(1.0))


def robust_scaled(df: DataFrame, value: str, by: list[str], clip: float = 6.0, out: str = "z") -> DataFrame:
    """(value - median) / (1.4826 MAD), clipped; a tiny scale counts as 1. Two aggregations, joined back by group."""
    median = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    rows = df.join(median, by)
    mad = rows.groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_d"))
    scale = F.lit(1.4826) * F.col("_d")
    z = (F.col(value) - F.col("_m")) / F.when(scale > 1e-9, scale).otherwise(1.0)
    return rows.join(mad, by).withColumn(out, F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))).drop("_m", "_d")


def max_normalised(df: DataFrame, value: str, out: str) -> DataFrame:
    """Divided by the maximum over all rows, which is joined as a single aggregated row."""
    top = df.agg(F.max(value).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.col(value) / F.col("_top")).drop("_top")


def logistic_score(up: Column, down: Column) -> Column:
    return 1 / (1 + F.exp(-(up - down)))


def zero_preserving_shift(entries: DataFrame, shifts: DataFrame, by: list[str]) -> DataFrame:
    """Moves non-zero entries alone, by the shift over the detected share. shifts: by, delta, detected."""
    moved = F.greatest(F.col("v") + F.col("delta") / F.col("detected"), F.lit(0.0))
    rows = entries.join(shifts, by, "left")
    sound = (F.col("v") > 0) & (F.col("detected") > 0)
    return rows.withColumn("v", F.when(sound, moved).otherwise(F.col("v"))).drop("delta", "detected")


def spline_basis(v: Column, knots: list[float], degree: int = 1) -> Column:
    """Truncated powers (v - knot)+ ^ degree."""
    return F.array(*(F.pow(F.greatest(v - F.lit(k), F.lit(0.0)), F.lit(degree)) for k in knots))


def one_hot(label: Column, vocabulary: list) -> Column:
    return F.array(*(F.when(label == x, 1).otherwise(0) for x in vocabulary))


def deduplicated_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Second and later occurrences of a name get ``__dupK`` in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("_k", k).withColumn(out, F.when(F.col("_k") > 0, F.concat(F.col(name), F.lit("__dup"), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_k")


def tokens(text: Column, separator: str = ";") -> Column:
    """Parts of a joined list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda t: F.trim(t)), lambda t: t != "")


def first_present(columns: list[str], names: list[str]) -> str | None:
    """The first of the names that a table has, whatever their case, as the table spells it."""
    own = {c.casefold(): c for c in reversed(columns)}
    return next((own[n.casefold()] for n in names if n.casefold() in own), None)


def lenient_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "y"), True).when(t.isin("0", "false", "no", "n"), False)


def lenient_double(text: Column) -> Column:
    """A finite number, or null."""
    v = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def digest(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Order-free digest of rows: the sha256 of their sha256s, one after the other in order; repeated rows count each.

    A group is sorted within a partition and hashed as its batches pass, so that no task holds a group; sorting spills.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)
    kinds, keys = dict(df.dtypes), by or ["_all"]
    rows = df.select(*(by or [F.lit(0).alias("_all")]), row.alias("_row"))
    schema = ", ".join(f"`{k}` {kinds.get(k, 'int')}" for k in keys) + ", digest string, n_rows long"

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, key, sha, n = [], None, hashlib.sha256(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types, strict=True)), pa.array([sha.hexdigest()]), pa.array([n])], [*keys, "digest", "n_rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([c.dictionary_encode("encode").indices.to_numpy() for c in batch.columns[:-1]])
            types, edges = [c.type for c in batch.columns[:-1]], np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                here = tuple(c[lo].as_py() for c in batch.columns[:-1])
                if here != key:
                    if key is not None:
                        yield out()
                    key, sha, n = here, hashlib.sha256(), 0
                sha.update("".join(batch.column(len(keys)).slice(lo, hi - lo).to_pylist()).encode())
                n += hi - lo
        if key is not None:
            yield out()

    found = rows.repartition(*keys).sortWithinPartitions(*keys, "_row").mapInArrow(chained, schema)
    return found if by else found.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def derived_seed(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")
