"""Operator 7: mixing sources to target weights, with DataFrame operations alone.

Temperature mixing: the weight of a source is its token share to the power of an exponent, normalised. The exponent is
bisected between 1 (as it is) and 0 (equal shares): downwards until the entropy of the weights reaches the target, or no
further than the repetition limit allows. The weights become token budgets, and a budget is realised as permutations of
the source's blocks: full passes over all its documents, then the head of one more permutation that fits the rest.

A document's block, and its place in the block, are a hash of seed and doc_id. Each pass permutes the numbers of a source's
blocks by a keyed bijection; a document's key in the pass is its block's new number, then its place in the block. Where a
budget ends is found by token sums of ranges of keys, from coarse to fine down to one block, and then by running sums inside
that block. So no window holds a source, however large, and no document is shuffled: its passes follow from its key.

Rows: a null source is a source of its own, apart from one that is named ``null``; a null text has no tokens; repeated rows are documents each, with one
hash, and come or stay away together; a null doc_id is hashed by its text instead. Without tokens all weights are equal and
every document comes once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BLOCK_ROWS = 512
"""About so many documents a block."""
BLOCK_BITS = 31
"""A source has 2 to the power of this many blocks at most; larger blocks beyond."""
LEVEL_BITS = 10
"""A range of keys is searched by parts, 2 to the power of this many at a time: what a window over one source holds."""


def n_tokens(text: str = "text") -> Column:
    """White-space-separated words of a text, counted without splitting it: places where a word begins."""
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.regexp_count(spaced, F.lit(" [^ ]")).cast("long")


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised weights of sources (name: tokens); sources without tokens have none."""
    total = sum(tokens.values())
    if not total:
        return {s: 1 / len(tokens) for s in tokens}
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    return {s: x / math.fsum(raw.values()) for s, x in raw.items()}


def entropy(w: dict) -> float:
    """As a share of its maximum over the sources that have a weight; 1 for a single one."""
    w = [x for x in w.values() if x > 0]
    return -math.fsum(x * math.log(x) for x in w) / math.log(len(w)) if len(w) > 1 else 1.0


def repeats(tokens: dict, w: dict) -> dict:
    """Passes over each source if the source with the least repetition is passed once: none loses a document."""
    rate = {s: w[s] / n for s, n in tokens.items() if n}
    least = min(rate.values(), default=1.0)
    return {s: rate[s] / least if n else 1.0 for s, n in tokens.items()}


def temperature(tokens: dict, target_entropy: float, max_repeats: float, steps: int = 60) -> float:
    """The largest exponent whose weights reach the target entropy, or where the repetition limit is met before it."""
    low, high = 0.0, 1.0

    def enough(a: float) -> bool:
        return entropy(weights(tokens, a)) >= target_entropy

    def allowed(a: float) -> bool:
        return max(repeats(tokens, weights(tokens, a)).values(), default=1.0) <= max_repeats

    def bisected(inside) -> float:
        """The boundary of a condition that holds at high."""
        below, above = low, high
        for _ in range(steps):
            mid = (below + above) / 2
            below, above = (below, mid) if inside(mid) else (mid, above)
        return above

    if enough(high):
        return high
    at_entropy = bisected(lambda a: not enough(a)) if enough(low) else low
    return at_entropy if allowed(at_entropy) else max(at_entropy, bisected(allowed))


def _id() -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))


def _shift(direction: str, x: Column, bits: Column) -> Column:
    return F.call_function(f"shift{direction}", x, bits)


ROUNDS = 3


def stirred(block: Column, mask: Column, k: int, *key: Column) -> Column:
    """x * odd + any, of round k and a key: a bijection of the numbers up to ``mask``, a power of two less one."""
    factor, step = (F.xxhash64(F.lit(2 * k + j), *key).bitwiseAND(F.lit((1 << 31) - 1)) for j in (0, 1))
    return (block * factor.bitwiseOR(F.lit(1)) + step).bitwiseAND(mask)


def folded(block: Column, half: Column) -> Column:
    """x ^ x >> half: another one."""
    return block.bitwiseXOR(_shift("right", block, half))


def keyed(rows: DataFrame, passes: Column, seed: int, mix: dict, name: str) -> DataFrame:
    """With ``name``: a document's place in a pass, 62 bits: its block's place, then its own in the block.

    Blocks are permuted step by step in columns of their own, as one expression would hold each step twice; the explosion of
    the one key keeps filters on it from being moved below, where they would hold the steps again."""
    bits = F.col("mix_bits")
    rest, mask = 62 - bits, _shift("left", F.lit(1).cast("long"), bits) - 1
    rows = rows.withColumns({"mix_bits": _by_source(mix, "bits", "int"), "mix_at": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("mix_id")), 2)})
    rows = rows.withColumn("mix_block", _shift("right", F.col("mix_at"), rest))
    for k in range(ROUNDS):
        rows = rows.withColumn("mix_block", stirred(F.col("mix_block"), mask, k, F.lit(seed), passes, F.col("mix_source")))
        rows = rows.withColumn("mix_block", folded(F.col("mix_block"), F.expr("(mix_bits + 1) div 2").cast("int")))
    own = F.col("mix_at").bitwiseAND(_shift("left", F.lit(1).cast("long"), rest) - 1)
    kept = [F.col(c) for c in rows.columns if c not in ("mix_bits", "mix_at", "mix_block", name)]
    return rows.select(*kept, F.explode(F.array(_shift("left", F.col("mix_block"), rest) + own)).alias(name))


def plan(slim: DataFrame, target_entropy: float, max_repeats: float, seed: int) -> dict:
    """For each source: weight, repeats, full passes, and the last key of the further pass that its budget still holds.

    ``slim``: mix_source, mix_id, mix_tokens. Sources are few: what is collected is a row for each of them.
    """
    known = {r["mix_source"]: r for r in slim.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows")).collect()}
    if not known:
        return {}
    tokens = {s: int(r["tokens"] or 0) for s, r in known.items()}
    weight = weights(tokens, temperature(tokens, target_entropy, max_repeats))
    often = {s: min(x, float(max_repeats)) if max_repeats >= 1 else x for s, x in repeats(tokens, weight).items()}
    out = {}
    for s, r in known.items():
        full = int(often[s] + 1e-9)
        bits = min(BLOCK_BITS, math.ceil(math.log2(r["rows"] / BLOCK_ROWS))) if r["rows"] > BLOCK_ROWS else 0
        out[s] = {"weight": weight[s], "repeats": often[s], "full": full, "rest": int((often[s] - full) * tokens[s]) if often[s] - full > 1e-9 else 0, "bits": bits, "last": -1}
    further = {s: x for s, x in out.items() if x["rest"] > 0}
    if further:
        rows = slim.where(F.col("mix_source").isin(list(further)))
        rows = keyed(rows, _by_source(further, "full", "int"), seed, further, "key").select("mix_source", "key", "mix_tokens")
        cut = {s: (0, x["rest"]) for s, x in further.items()}  # the first key of a range, and the tokens left for it
        level = {s: 62 for s in further}
        while any(level[s] > 62 - further[s]["bits"] for s in further):
            level = {s: max(62 - further[s]["bits"], level[s] - LEVEL_BITS) for s in further}
            cut = _descend(rows, cut, level, further)
        at = _by_source({s: {"v": cut[s][0]} for s in further}, "v", "long")
        width = _by_source({s: {"v": 1 << level[s]} for s in further}, "v", "long")
        block = rows.where((F.col("key") >= at) & (F.col("key") < at + width)).groupBy("mix_source", "key").agg(F.sum("mix_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("mix_source").orderBy("key"))
        left = _by_source({s: {"v": cut[s][1]} for s in further}, "v", "long")
        fits = block.withColumn("upto", upto).where(F.col("upto") <= left).groupBy("mix_source").agg(F.max("key").alias("last"))
        last = {r["mix_source"]: r["last"] for r in fits.collect()}
        for s in further:
            out[s]["last"] = last.get(s, cut[s][0] - 1)
    return out


def _descend(rows: DataFrame, cut: dict, level: dict, further: dict) -> dict:
    """One level down: in each source the range of keys of ``level`` bits in which the budget ends."""
    at = _by_source({s: {"v": cut[s][0]} for s in further}, "v", "long")
    bits = _by_source({s: {"v": level[s]} for s in further}, "v", "int")
    left = _by_source({s: {"v": cut[s][1]} for s in further}, "v", "long")
    width = _by_source({s: {"v": 1 << min(62, level[s] + LEVEL_BITS)} for s in further}, "v", "long")
    here = rows.where((F.col("key") >= at) & (F.col("key") - at < width))
    parts = here.groupBy("mix_source", F.call_function("shiftright", F.col("key") - at, bits).alias("part"))
    sums = parts.agg(F.sum("mix_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("mix_source").orderBy("part"))
    ends = sums.withColumn("upto", upto).where(F.col("upto") > left).groupBy("mix_source").agg(F.min(F.struct("part", (F.col("upto") - F.col("n")).alias("before"))).alias("m"))
    found = {r["mix_source"]: r["m"] for r in ends.collect()}
    return {s: (cut[s][0] + (found[s]["part"] << level[s]), cut[s][1] - found[s]["before"]) if s in found else (cut[s][0] + (1 << min(62, level[s] + LEVEL_BITS)) - (1 << level[s]), cut[s][1]) for s in cut}


def _by_source(values: dict, name: str, kind: str) -> Column:
    """A value of each source as a literal map, looked up by mix_source."""
    pairs = [x for s, v in values.items() for x in (F.lit(s), F.lit(v[name]).cast(kind))]
    return F.element_at(F.create_map(*pairs), F.col("mix_source"))


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(_source().alias("mix_source"), _id().alias("mix_id"), n_tokens().alias("mix_tokens"))


def _source() -> Column:
    """The source's name; ``null`` for none, so what is named that, with any NULs after it, gets one more NUL."""
    return F.when(F.col("source").isNull(), F.lit("null")).when(F.col("source").rlike("^null\\x00*$"), F.concat("source", F.lit("\x00"))).otherwise(F.col("source"))


def scheduled(docs: DataFrame, mix: dict, seed: int, places: bool = True) -> DataFrame:
    """Each document as often as its source's budget says, without a shuffle.

    With places adds mix_pass and mix_place (0 to 1), in place of columns of these names; ordered by mix_place, the passes of
    every source are spread evenly over the whole.
    """
    packed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), _source().alias("mix_source"), _id().alias("mix_id"))
    if not mix:
        rows = packed.limit(0).withColumns({"mix_pass": F.lit(0), "mix_place": F.lit(0.0)})
    else:
        full = _by_source(mix, "full", "int")
        rows = keyed(packed, full, seed, mix, "mix_key")
        more = (F.col("mix_key") <= _by_source(mix, "last", "long")).cast("int")
        rows = rows.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), full + more - 1)))
        if places:
            rows = keyed(rows, F.col("mix_pass"), seed, mix, "mix_key")
            place = (F.col("mix_pass") + F.col("mix_key") / F.lit(float(1 << 62))) / _by_source(mix, "repeats", "double")
            rows = rows.withColumn("mix_place", F.least(place, F.lit(1.0)))
    own = ["mix_pass", "mix_place"] if places else []
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in own), *own)


def mixed(docs: DataFrame, target_entropy: float = 0.93, max_repeats: float = 2.0, seed: int = 13, places: bool = True) -> DataFrame:
    """The mixture of docs (doc_id, text, source): every document, some repeated, with mix_pass and mix_place if asked.

    The budget is such that the source passed least is passed once, so that no document is lost.
    """
    counted = stored(slim(docs), "mixing")
    return scheduled(docs, plan(counted, target_entropy, max_repeats, seed), seed, places)
