"""Operator 11: spelling variants by merging in an errata trie.

1. Words. The runs of letters of whole texts are counted; partial counts of a task are added up by word.
2. Parts. The words in code-point order are the leaves of a trie. Split words from a bounded sample cut that order into parts;
   nodes that lie above a split are shared by several parts, all other nodes lie within one part with all that is below them.
3. Within a part. Every branching node has a heavy child, that with the most words below it. The words of its light children
   are merged once more with one character replaced (what follows the character, below the node), skipped (the same, at the
   node itself) or put in (the heavy child's character before it). Where such a merged word ends on a leaf, the two words are
   one edit apart; where two light words end on one leaf, they differ in one character. A word is light at most as often as
   the logarithm of the part's size, so merging is small-to-large.
4. At shared nodes no child is heavy: all words below them are merged, by a shuffle on what they merge to. A word has few
   shared nodes, about as many as it takes characters to tell parts apart.
5. Each pair of near words is found once in all: a skipped character is the last of its run of equal ones. Per word only the
   number of near words and the best of them are kept, so no group is expanded into its pairs. At most one word for each
   letter shares a replaced place, which bounds the groups of the shuffle whatever the input.
6. Roots. Every step to a form doubles a word's count at least, so chains are short; pointers are doubled until they rest.

Rows: null texts have no words, a null doc_id is hashed as empty text, repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

LETTERS = "A-Za-zÀ-ÿ"
DAMAGED = 97
"""One in so many runs of a document, by hash, loses a character."""
PART_WORDS = 1 << 14
"""About so many words a part."""
HELD = 400_000
"""Distinct words that a task holds before it hands over their counts."""
SPLIT_LENGTH = 64
"""A split is cut after so many characters; words that are alike for longer stay in one part."""
GAP = "*"
"""Stands for a replaced character; no letter."""


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: words of ``shortest`` characters or more that occur ``least`` times or more."""
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begun, here = zlib.crc32(f"{ident}:".encode()), {}
                for word in run.findall(text.as_buffer().to_pybytes().lower().decode()):
                    here[word] = here.get(word, 0) + 1
                for word, n in here.items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield out()
        yield out()
        tidy()

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def split_words(words: DataFrame, part_words: int) -> list[str]:
    """Where parts begin: quantiles of a sample by hash, about 16 words a part; none if all is one part."""
    parts = -(-words.count() // part_words)
    if parts < 2:
        return []
    share = min(1.0, 16 * part_words ** -1)
    taken = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted(r[0] for r in words.where(taken).select(F.substring("word", 1, SPLIT_LENGTH)).collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def shared_nodes(splits: list[str]) -> set[str]:
    """The nodes with words on both sides of a split below them."""
    return {s[:d] for s in splits for d in range(len(s))}


class Near:
    """For each word how many near words were found, and the best of them: the largest count, then the first in order."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words = words
        self.key = dict(zip(words, ((-n, w) for n, w in zip(counts, words, strict=True)), strict=True))
        self.found = dict.fromkeys(words, 0)
        self.best: dict[str, tuple[int, str]] = {}

    def _one(self, word: str, other: tuple[int, str], n: int = 1) -> None:
        self.found[word] += n
        have = self.best.get(word)
        if have is None or other < have:
            self.best[word] = other

    def pair(self, a: str, b: str) -> None:
        if b in self.key:
            self._one(a, self.key[b])
            self._one(b, self.key[a])

    def group(self, words: list[str]) -> None:
        """Words all of which are near each other."""
        first, second = sorted(self.key[w] for w in words)[:2]
        for w in words:
            self._one(w, second if w == first[1] else first, len(words) - 1)


def merge_part(words: list[str], counts: list[int], shared: set[str]) -> Near:
    """Near words below the part's own nodes. ``words`` are distinct and in order."""
    near, waiting = Near(words, counts), [(0, len(words))]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < 2:
            continue
        first, last = words[lo], words[hi - 1]
        depth = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), len(first))
        node, children = first[:depth], []
        at = ends = lo + (len(first) == depth)
        while at < hi:
            ends = bisect_left(words, node + chr(ord(words[at][depth]) + 1), at, hi)
            children.append((at, ends))
            at = ends
        waiting += children
        if node in shared:
            continue
        heavy = max(children, key=lambda c: (c[1] - c[0], -c[0]))
        letter = words[heavy[0]][depth]
        if len(first) == depth:
            near.pair(first, node + letter)
        merged: dict[str, list[str]] = {}
        for child in children:
            if child == heavy:
                continue
            for word in words[child[0] : child[1]]:
                rest = word[depth + 1 :]
                near.pair(word, node + letter + rest)
                near.pair(word, node + letter + word[depth:])
                if rest[:1] != word[depth]:
                    near.pair(word, node + rest)
                merged.setdefault(rest, []).append(word)
        for alike in merged.values():
            if len(alike) > 1:
                near.group(alike)
    return near


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, n_near, near_n, near_word: the number of near words and the best of them (null without). ``words`` is read several times."""
    splits = split_words(words, part_words)
    shared = shared_nodes(splits)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [bisect_right(splits, w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], ["part", "word", "n"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")  # by bytes, which is code-point order
        words, counts = table["word"].to_pylist(), table["n"].to_pylist()
        near = merge_part(words, counts, shared)
        best = [near.best.get(w, (None, None)) for w in words]
        return pa.table({"word": words, "n": counts, "n_near": pa.array(near.found.values(), pa.int64()), "k": pa.array([b[0] for b in best], pa.int64()), "w": pa.array([b[1] for b in best], pa.string())})

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What words merge to at shared nodes, and the words themselves, on which skipped ones may end."""
        for b in batches:
            keys, roles, who, counts = [], [], [], []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = [(word, "leaf")]
                for d in range(len(word)):
                    if word[:d] not in shared:
                        break
                    rest = word[d + 1 :]
                    to.append((word[:d] + GAP + rest, "replaced"))
                    if rest[:1] != word[d]:
                        to.append((word[:d] + rest, "skipped"))
                for key, role in to:
                    keys.append(key)
                    roles.append(role)
                    who.append(word)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(roles, pa.string()), pa.array(who, pa.string()), pa.array(counts, pa.int64())], ["key", "role", "word", "n"])

    own = words.mapInArrow(parts, "part int, word string, n long").groupBy("part").applyInArrow(merge, "word string, n long, n_near long, k long, w string")
    found = own.select("word", "n", "n_near", F.when(F.col("w").isNotNull(), F.struct("k", "w")).alias("best"))
    if shared:
        me = F.struct((-F.col("n")).alias("k"), F.col("word").alias("w"))
        key = Window.partitionBy("key")
        order = key.orderBy("k", "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = words.mapInArrow(upper, "key string, role string, word string, n long").withColumn("k", -F.col("n")).withColumn("me", me)
        met = met.select(
            "word", "n", "role", F.count("*").over(key).alias("all"), F.max(F.when(F.col("role") == "leaf", F.col("me"))).over(key).alias("leaf"), F.min(F.when(F.col("role") == "skipped", F.col("me"))).over(key).alias("skipped"),
            F.first("me").over(order).alias("first"), F.nth_value("me", 2).over(order).alias("second"), "me",
        )
        n = F.when(F.col("role") == "skipped", F.col("leaf").isNotNull().cast("long")).otherwise(F.col("all") - 1)
        best = F.when(F.col("role") == "replaced", F.when(F.col("first") == F.col("me"), F.col("second")).otherwise(F.col("first"))).when(F.col("role") == "leaf", F.col("skipped")).otherwise(F.col("leaf"))
        met = met.select("word", "n", n.alias("n_near"), best.alias("best")).where("n_near > 0")
        found = found.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n", "n_near", (-F.col("best.k")).alias("near_n"), F.col("best.w").alias("near_word"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a table of word, form without circles: where following forms ends. Words without a form are left out."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        moved = at.join(next_, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved"))
        at = stored(moved, "roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2, part_words: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word's form is its best near word if that occurs ``ratio`` (2 or more) times as often."""
    if ratio < 2:
        raise ValueError("ratio below 2")
    words = stored(word_counts(docs, shortest, least), "words")
    form = F.col("near_n") >= ratio * F.col("n")
    table = stored(near_words(words, part_words).select("word", "n", "n_near", F.when(form, F.col("near_word")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")), "near")
    root = roots(table.where("form is not null"))
    return table.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
