"""Operator 12: divergence of a language's sources, by mergeable radix tries.

1. Count. A task counts the terms of whole texts (runs of letters a-z, A-Z lower-cased, and of bytes of characters beyond
   ASCII) in byte tries whose leaves hold, for each (lang, source) group, occurrences and documents. A trie is written in pre-order: of each term the number of bytes that it shares with the one before, and the
   bytes after them. It is handed over in pieces of bounded size when the task holds enough, and at its end.
2. Merge. The pieces' first terms, each standing for as many counters, give the splits that cut the order of bytes into ranges of
   about equal numbers of counters. Pieces are cut at splits and merged by range: equal terms meet, their counters add up. A
   range that is heavy because of one term (all tasks have it) is merged in parts first, as often as that halves it.
3. Keep. In a merged trie a term's documents of a language are known; terms in enough of them stay.
4. Traverse. A first traversal adds up each group's occurrences. The second walks the kept terms in UTF-8 order, in blocks: for all
   sources of the language probabilities are whole numbers, whose differences are added up by pair of sources, and each group
   keeps its best terms; the first in order win ties. Sums and candidates of a task leave it once.

Whole numbers are exact while a group's occurrences plus five times the kept terms stay below 2**63 / 1000. Pair sums are held
for ``CELLS`` pairs a task; of languages with more sources than that takes, stripes are handed over block by block.
Every task gets the list of groups (its square is the size of the result).

Rows: null text, lang and source are empty text. Each row is one document, repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import long_rows, stored, stored_at, tidy

HELD = 1 << 23
"""Bytes of texts that a task counts in one trie."""
PIECE = 4096
"""Leaf counters of a piece, about."""
BATCH = 32
"""Pieces handed to Python at a time: one is about 0.1 MB, so that a full batch of short rows would be 100 MB, on both sides."""
GROUP = 1 << 23
"""Bytes of a row group of pieces, encoded; decoded they are some times as many."""
RANGE = 250_000
"""Leaf counters that meet in one range, about, before they are merged."""
SPLIT_BYTES = 64
"""A split is cut after so many bytes; terms alike for longer stay in one range."""
CELLS = 1 << 22
ONE = 1_000_000_000
SMOOTH = 5

PIECES = "low binary, high binary, counters long, shared array<int>, sizes array<int>, tail binary, fan array<int>, langs array<string>, sources array<string>, grp array<int>, n array<long>, docs array<long>"


class Trie:
    """Terms in byte order, and of each term its counters: a group, occurrences, documents."""

    def __init__(self, terms: list[bytes], fan: np.ndarray, grp: np.ndarray, n: np.ndarray, docs: np.ndarray, groups: list[tuple[str, str]]):
        self.terms, self.fan, self.grp, self.n, self.docs, self.groups = terms, fan, grp, n, docs, groups

    @staticmethod
    def counted(data: np.ndarray, ends: np.ndarray, group: np.ndarray, groups: list[tuple[str, str]]) -> Trie:
        """The trie of texts that lie together in ``data``, each up to one of ``ends`` and of a group.

        Terms are numbered in byte order, and each occurrence becomes one number of term, group and text: sorted, leaves lie together and the
        texts of each leaf too, so occurrences and documents are lengths of runs."""
        data = textvec.lowered(data)
        letter = ((data - np.uint8(0x61)) < 26) | (data >= 0x80)
        first = np.zeros(len(data) + 1, bool)
        first[0] = True
        first[ends] = True  # nothing runs over from one text to the next
        begins = np.flatnonzero(letter & (first[:-1] | ~np.concatenate([[False], letter[:-1]])))
        stops = np.flatnonzero(letter & (first[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
        if not len(begins):
            return Trie([], *(np.zeros(0, np.int64) for _ in range(4)), groups)
        text = np.searchsorted(ends, begins, "right").astype(np.int32)
        offsets = np.zeros(len(begins) + 1, np.int64)
        np.cumsum(stops - begins, out=offsets[1:])
        data = data[letter]
        del begins, stops, first, letter  # what is not needed any more goes at once: it is as much as what follows
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        del data, offsets
        names = coded.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width, texts = max(len(groups), 1), len(ends)
        key = place[coded.indices.to_numpy()]
        del coded
        key *= width
        key += group[text]
        key *= texts
        key += text
        del text
        key.sort()
        each = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # a leaf's texts
        key //= texts
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        docs = np.diff(np.searchsorted(each, at), append=len(each))
        n = np.diff(at, append=len(key))
        leaf = key[at]
        return Trie([names[i] for i in order], np.bincount(leaf // width, minlength=len(order)), (leaf % width).astype(np.int32), n, docs, groups)

    @staticmethod
    def of_leaves(terms: pa.Array, of: np.ndarray, grp: np.ndarray, n: np.ndarray, docs: np.ndarray, groups: list[tuple[str, str]]) -> Trie:
        """From counters, each of the term at ``of`` and a group; terms may repeat, counters of one term and group are added up."""
        coded = terms.dictionary_encode()
        names = coded.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = max(len(groups), 1)
        key = place[coded.indices.to_numpy()][of] * width + grp
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        n, docs = (np.add.reduceat(c[by], first) if len(first) else c for c in (n, docs))
        key = key[first]
        return Trie([names[i] for i in order], np.bincount(key // width, minlength=len(order)), (key % width).astype(np.int32), n, docs, groups)

    @staticmethod
    def merged(tries: Iterable[Trie]) -> Trie:
        """Of each trie that comes its terms are kept as an array, and its names of groups not at all: many tries meet in a range."""
        index, parts = {}, []
        for t in tries:
            of = np.array([index.setdefault(g, len(index)) for g in t.groups], np.int32)
            parts.append((pa.array(t.terms, pa.binary()), t.fan, of[t.grp], t.n, t.docs))
        terms, *counters = zip(*parts, strict=True)
        del parts
        terms, (fan, grp, n, docs) = pa.concat_arrays(terms), (np.concatenate(c) for c in counters)
        return Trie.of_leaves(terms, np.repeat(np.arange(len(terms)), fan), grp, n, docs, list(index))

    def cut(self, lo: int, hi: int, at: np.ndarray | None = None) -> Trie:
        """The terms from ``lo`` to ``hi``; ``at``: where each term's counters begin, if that is known."""
        if at is None:
            at = np.concatenate([[0], np.cumsum(self.fan)])
        a, b = at[lo], at[hi]
        used, grp = np.unique(self.grp[a:b], return_inverse=True)
        return Trie(self.terms[lo:hi], self.fan[lo:hi], grp.astype(np.int32), self.n[a:b], self.docs[a:b], [self.groups[i] for i in used])

    def pieces(self, size: int = PIECE) -> Iterator[Trie]:
        at, lo = np.concatenate([[0], np.cumsum(self.fan)]), 0
        while lo < len(self.terms):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            yield self.cut(lo, hi, at)
            lo = hi

    def row(self) -> dict:
        """In pre-order."""
        sizes = np.array([len(t) for t in self.terms], np.int64)
        data, at = np.frombuffer(b"".join(self.terms), np.uint8), np.concatenate([[0], np.cumsum(sizes)])[:-1]
        shared, alike = np.zeros(len(sizes), np.int64), np.arange(1, len(sizes))
        depth = 0
        while len(alike):
            alike = alike[(sizes[alike] > depth) & (sizes[alike - 1] > depth)]
            alike = alike[data[at[alike] + depth] == data[at[alike - 1] + depth]]
            depth += 1
            shared[alike] = depth
        keep = np.arange(len(data)) - np.repeat(at, sizes) >= np.repeat(shared, sizes)
        return {
            "low": self.terms[0][:SPLIT_BYTES], "high": self.terms[-1][:SPLIT_BYTES], "counters": int(self.fan.sum()), "shared": shared.astype(np.int32), "sizes": (sizes - shared).astype(np.int32), "tail": data[keep].tobytes(), "fan": self.fan.astype(np.int32),
            "langs": [g[0] for g in self.groups], "sources": [g[1] for g in self.groups], "grp": self.grp, "n": self.n, "docs": self.docs,
        }

    @staticmethod
    def read(row: dict) -> Trie:
        terms, before, at, tail = [], b"", 0, row["tail"]
        for k, size in zip(row["shared"].tolist(), row["sizes"].tolist(), strict=True):
            before = before[:k] + tail[at : at + size]
            at += size
            terms.append(before)
        return Trie(terms, row["fan"], row["grp"], row["n"], row["docs"], list(zip(row["langs"].tolist(), row["sources"].tolist(), strict=True)))


def _types(extra: str = "") -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in (extra + PIECES).split(", ")]
    return pa.schema([(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]) for name, kind in fields])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows with arrays as numpy arrays."""
    lists = {f.name for f in batch.schema if pa.types.is_list(f.type)}
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) if name in lists else batch.column(name)[i].as_py() for name in batch.schema.names}


def local_tries(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Pieces of the tries of all tasks; a trie is of about ``held`` bytes of texts, or of one longer text."""
    schema = _types()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        group: list[int] = []
        groups: dict[tuple[str, str], int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            ends, whole = np.cumsum([len(p) for p in parts]), [np.concatenate(parts)]
            parts.clear()
            trie = Trie.counted(whole.pop(), ends, np.array(group, np.int32), list(groups))
            group.clear()
            groups.clear()
            for piece in trie.pieces():
                yield _batch([piece.row()], schema)

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if size and size + len(data) > held:
                    yield from out()
                    size = 0
                parts.append(data)
                group.append(groups.setdefault((lang, source), len(groups)))
                size += len(data)
        if parts:
            yield from out()
        tidy()

    return _filled(docs).where("text != ''").mapInArrow(rows, PIECES)


def _pieces_stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, which is made of pieces, written and read again; few pieces are read and handed over at a time."""
    with long_rows(df.sparkSession, BATCH, GROUP):
        return stored_at(df, name, rows=BATCH)[0]


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def split_terms(pieces: DataFrame, size: int, sample: int = 1 << 15) -> list[bytes]:
    """Where ranges begin: quantiles of the pieces' first terms by counters; of very many pieces a sample by hash."""
    count, total = pieces.agg(F.count("*"), F.coalesce(F.sum("counters"), F.lit(0))).first()
    ranges = -(-total // size)
    if ranges < 2:
        return []
    share = int(min(1.0, max(sample, 32 * ranges) / count) * (1 << 30))
    with long_rows(pieces.sparkSession, BATCH, GROUP):
        found = pieces.where(F.pmod(F.xxhash64("tail", "n"), F.lit(1 << 30)) < share).select("low", "counters").toArrow()
    if not found.num_rows:
        return []
    low, counters = found.column("low").to_pylist(), found.column("counters").to_numpy()
    order = sorted(range(len(low)), key=low.__getitem__)
    upto = np.cumsum(counters[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return sorted({low[order[i]] for i in at} - {b""})


def cut_pieces(pieces: DataFrame, splits: list[bytes]) -> DataFrame:
    """range before the columns of pieces, which are cut where a range ends."""
    schema = _types("range int, ")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                first, last = bisect_right(splits, row["low"]), bisect_right(splits, row["high"])
                if first == last:
                    yield _batch([row | {"range": first}], schema)
                    continue
                trie = Trie.read(row)
                cuts = [0, *(bisect_left(trie.terms, splits[r]) for r in range(first, last)), len(trie.terms)]
                parts = [trie.cut(a, b).row() | {"range": first + i} for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield _batch(parts, schema)

    return pieces.mapInArrow(rows, "range int, " + PIECES)


def merge_tries(ranged: DataFrame, size: int, least: int) -> DataFrame:
    """Pieces of merged tries: each term stands in one of them, once, if it is kept."""
    schema = _types("range int, ")

    def merge(table: pa.Table) -> pa.Table:
        trie = Trie.merged(Trie.read(r) for r in _rows(table))
        where = table.column("range")[0].as_py()
        return pa.Table.from_batches([_batch([p.row() | {"range": where} for p in trie.pieces()], schema)])

    def keep(table: pa.Table) -> pa.Table:
        trie = kept_terms(Trie.merged(Trie.read(r) for r in _rows(table)), least)
        rows = [p.row() for p in trie.pieces()]
        return pa.Table.from_batches([_batch(rows, _types())])

    ranged, before = _pieces_stored(ranged, "ranges"), None
    while True:
        heavy = stored(ranged.groupBy("range").agg(F.sum("counters").alias("total")).where(F.col("total") > 2 * size), "heavy")
        now = heavy.agg(F.sum("total")).first()[0] or 0
        if not now or before is not None and 2 * now > before:
            break
        before = now
        # Of heavy ranges there are fewer than splits, which all tasks have anyway; the others' pieces stay as they are.
        dealt = ranged.join(F.broadcast(heavy), "range").withColumn("slot", F.pmod(F.xxhash64("tail", "n"), F.ceil(F.col("total") / size)))
        parts = dealt.select("slot", *ranged.columns).groupBy("range", "slot").applyInArrow(merge, "range int, " + PIECES)
        ranged = ranged.join(F.broadcast(heavy.select("range")), "range", "left_anti").unionByName(_pieces_stored(parts, "ranges"))
    return ranged.groupBy("range").applyInArrow(keep, PIECES)


def kept_terms(trie: Trie, least: int) -> Trie:
    """Counters of the terms that are in ``least`` documents of their language or more."""
    langs = {name: i for i, name in enumerate(dict.fromkeys(g[0] for g in trie.groups))}
    lang = np.array([langs[g[0]] for g in trie.groups], np.int64)[trie.grp] if len(trie.grp) else trie.grp
    term = np.repeat(np.arange(len(trie.terms)), trie.fan)
    docs = np.zeros((len(trie.terms), max(len(langs), 1)), np.int64)
    np.add.at(docs, (term, lang), trie.docs)
    stays = docs[term, lang] >= least
    fan = np.bincount(term[stays], minlength=len(trie.terms))
    return Trie([t for t, f in zip(trie.terms, fan.tolist(), strict=True) if f], fan[fan > 0], trie.grp[stays], trie.n[stays], trie.docs[stays], trie.groups)


def probability(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (count + SMOOTH) / whole), by long division in steps that stay within 63 bits."""
    rest, out = count + SMOOTH, np.zeros(np.broadcast_shapes(count.shape, whole.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _by_lang(trie: Trie) -> Iterator[tuple[str, list[bytes], np.ndarray, list[str], np.ndarray, np.ndarray]]:
    """Of each language: its terms in order, and of its counters the term, the source and occurrences."""
    term = np.repeat(np.arange(len(trie.terms)), trie.fan)
    for lang in dict.fromkeys(g[0] for g in trie.groups):
        mine = np.array([g[0] == lang for g in trie.groups])[trie.grp]
        used, at = np.unique(term[mine], return_inverse=True)
        yield lang, [trie.terms[i] for i in used], at, [g[1] for g in trie.groups], trie.grp[mine], trie.n[mine]


def totals(kept: DataFrame) -> DataFrame:
    """lang, source, n, terms: occurrences of kept terms by group; rows of a null source have the number of kept terms of the language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, terms = Counter(), Counter()
        for batch in batches:
            for row in _rows(batch):
                for lang, mine, _, sources, grp, counts in _by_lang(Trie.read(row)):
                    terms[lang] += len(mine)
                    for g in np.unique(grp).tolist():
                        n[lang, sources[g]] += int(counts[grp == g].sum())
        out = [(a, b, x, 0) for (a, b), x in n.items()] + [(a, None, 0, x) for a, x in terms.items()]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "n", "terms"])

    found = _pieces_stored(kept.mapInArrow(rows, "lang string, source string, n long, terms long"), "totals")
    return found.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms"))


class Language:
    """What a traversal needs of a language: its sources and what their probabilities are taken of."""

    def __init__(self, sources: dict[str, int], terms: int):
        self.names = list(sources)
        self.index = {s: i for i, s in enumerate(self.names)}
        n = np.fromiter(sources.values(), np.int64, len(sources))
        self.whole, self.all = n + SMOOTH * terms, n.sum() + SMOOTH * terms


class Traversal:
    """Pair sums and the best terms of each group, over the kept terms that a task meets in order."""

    def __init__(self, languages: dict[str, Language], best: int, cells: int):
        self.languages, self.best, self.cells = languages, best, cells
        self.pairs: dict[str, np.ndarray] = {}
        self.top: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def walk(self, trie: Trie) -> Iterator[tuple]:
        """Takes a trie in; gives the pair sums of languages too large to hold."""
        for lang, terms, at, sources, grp, n in _by_lang(trie):
            of = self.languages[lang]
            width = len(of.names)
            where = np.array([of.index.get(s, 0) for s in sources], np.int64)[grp]
            step = max(1, self.cells // width)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(0, len(terms) + step, step))
            for lo, a, b in zip(range(0, len(terms), step), edges[:-1], edges[1:], strict=False):
                mine = order[a:b]
                count = np.zeros((min(step, len(terms) - lo), width), np.int64)
                count[at[mine] - lo, where[mine]] = n[mine]
                p = probability(count, of.whole)
                self._candidates(lang, terms[lo : lo + step], count, p, probability(count.sum(1), of.all))
                yield from self._sums(lang, p)

    def _sums(self, lang: str, p: np.ndarray) -> Iterator[tuple]:
        width = p.shape[1]
        if width * width <= self.cells:
            held = self.pairs.setdefault(lang, np.zeros((width, width), np.int64))
            for i in range(width):
                held[i, i + 1 :] += np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(0)
        else:
            for i in range(width):
                yield lang, i, i + 1, np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(0)

    def _candidates(self, lang: str, terms: list[bytes], count: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        gap = np.where(count > 0, p - q[:, None], 0)
        for i in np.flatnonzero((gap > 0).any(0)).tolist():
            at = np.flatnonzero(gap[:, i] > 0)
            at = at[np.argsort(-gap[at, i], kind="stable")[: self.best]]
            new = [(-int(gap[k, i]), terms[k]) for k in at]
            self.top[lang, i] = sorted(self.top.get((lang, i), []) + new)[: self.best]

    def sums(self) -> Iterator[tuple]:
        for lang, held in self.pairs.items():
            for i in range(len(held) - 1):
                yield lang, i, i + 1, held[i, i + 1 :]


OUT = "lang string, source string, part string, item string, value long"


def divergence(docs: DataFrame, least: int = 30, best: int = 50, held: int = HELD, size: int = RANGE, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: each other source of the language, by summed difference of
    probabilities over the kept terms; ``term``: the ``best`` kept terms that the source has more of than its language."""
    spark = docs.sparkSession
    with long_rows(spark, BATCH, GROUP):
        pieces = stored(local_tries(docs, held), "tries")
    kept = _pieces_stored(merge_tries(cut_pieces(pieces, split_terms(pieces, size)), size, least), "kept")
    groups = stored(_filled(docs).select("lang", "source").distinct(), "groups")
    terms, counts = {}, {}
    for r in groups.join(totals(kept), ["lang", "source"], "full").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms")).toLocalIterator():
        if r["source"] is None:
            terms[r["lang"]] = r["terms"]
        else:
            counts.setdefault(r["lang"], {})[r["source"]] = r["n"]
    shared = spark.sparkContext.broadcast({lang: Language(dict(sorted(s.items())), terms.get(lang, 0)) for lang, s in counts.items()})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Traversal(shared.value, best, cells)

        def out(lang: str, i: int, first: int, sums: np.ndarray) -> pa.RecordBatch:
            names, n = walk.languages[lang].names, len(sums)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([lang] * n, [names[i]] * n, ["pair"] * n, names[first : first + n])] + [pa.array(sums, pa.int64())], ["lang", "source", "part", "item", "value"])

        for batch in batches:
            for row in _rows(batch):
                for x in walk.walk(Trie.read(row)):
                    yield out(*x)
        for x in walk.sums():
            yield out(*x)
        for (lang, i), found in walk.top.items():
            n, name = len(found), walk.languages[lang].names[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([lang] * n, [name] * n, ["term"] * n, [t.decode() for _, t in found])] + [pa.array([-v for v, _ in found], pa.int64())], ["lang", "source", "part", "item", "value"])
        tidy()

    met = _pieces_stored(kept.mapInArrow(rows, OUT), "met")
    once = met.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source != item")
    pair = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    term = met.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= best)
    return pair.withColumn("rank", F.row_number().over(ranked)).unionByName(term)
