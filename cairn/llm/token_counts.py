"""Operator 5: token counts under a unigram model, by dynamic programming shared along a trie.

The pre-tokens of a text are its white-space-separated words, each with the mark U+2581 before it. The distinct pre-tokens
of a batch are inserted in a trie over their bytes. The forward score of a trie node - the best sum of piece scores over
all ways to cut its prefix - is computed once from the nodes above it, level by level, and serves all pre-tokens that share
the prefix; the node where a pre-token ends stores its token count. A byte that no piece covers is a token of its own, at a
penalty. Among equal scores the way with fewer tokens is taken.

The vocabulary file lists pieces by rank and has no probabilities; the score of the piece of rank r is log(1 / (r + 2)).

Rows: null and empty texts have no tokens. Other columns are ignored; repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import tidy, worker_keeps

MARK = "▁".encode()
PENALTY = -40.0
LONG = 200
"""Bytes beyond which a word's forward scores are computed on its own, as hardly any word shares its nodes."""
CACHED_WORDS = 1_500_000


class Vocabulary:
    """Pieces as bytes, with scores; looked up by the hash of their bytes behind a small filter."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        data = np.frombuffer(b"".join(scores), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(x) for x in scores])]).astype(np.int64)
        sums = _sums(data)
        keys = _range_hash(sums, at[:-1], at[1:])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(scores.values(), float, len(scores))[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pieces, and the scores of those."""
        maybe = np.flatnonzero(self.filter[(keys >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == keys[maybe]
        return maybe[hit], self.values[place[hit]]


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textvec._BYTE[data] * textvec._power("up", len(data) + 1)[: len(data)], out=out[1:])
    return out


def _range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return textvec.mix((sums[end] - sums[start]) * textvec._power("down", len(sums))[start])


def load_pieces(path: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece model that are neither control, unknown nor single-byte entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i).encode(): float(-np.log(i + 2)) for i in usable}


def chain_count(vocabulary: Vocabulary, word: bytes) -> int:
    """Tokens of one word by the recurrence on its own chain of prefixes."""
    n, scores, longest = len(word), vocabulary.scores, vocabulary.longest
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, n + 1):
        score, count = best[end - 1]
        top = (score + PENALTY, -count - 1)
        for start in range(max(0, end - longest), end):
            piece = scores.get(word[start:end])
            if piece is not None:
                top = max(top, (best[start][0] + piece, -best[start][1] - 1))
        best.append((top[0], -top[1]))
    return best[n][1]


def long_count(vocabulary: Vocabulary, word: bytes, step: int = 1 << 14) -> int:
    """The same for a long word: pieces that end in a stretch of it are looked up together, and only those met one by one."""
    data = np.frombuffer(word, np.uint8)
    sums, back = _sums(data), vocabulary.longest
    score, count = [0.0], [0]  # of the last ``back`` prefixes, the newest last
    for lo in range(0, len(data), step):
        hi = min(lo + step, len(data))
        ends, lengths, gains = [], [], []
        for length in range(1, min(back, hi) + 1):
            end = np.arange(max(lo + 1, length), hi + 1)
            found, value = vocabulary.find(_range_hash(sums, end - length, end))
            ends.append(end[found])
            lengths.append(np.full(len(found), length))
            gains.append(value)
        end, length, gain = np.concatenate(ends), np.concatenate(lengths), np.concatenate(gains)
        order = np.argsort(end, kind="stable")
        cut = np.searchsorted(end[order], np.arange(lo + 1, hi + 2)).tolist()
        length, gain = length[order].tolist(), gain[order].tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            top, least = score[-1] + PENALTY, count[-1] + 1
            for k in range(a, b):
                total, pieces = score[-length[k]] + gain[k], count[-length[k]] + 1
                if total > top or total == top and pieces < least:
                    top, least = total, pieces
            score.append(top)
            count.append(least)
        score, count = score[-back:], count[-back:]
    return count[-1]


def trie_counts(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Tokens of distinct words (with their marks), by forward scores that are computed once per trie node."""
    out = np.zeros(len(words), np.int64)
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for i in set(range(len(words))) - set(short):
        out[i] = long_count(vocabulary, words[i])
    short.sort(key=words.__getitem__)
    if not short:
        return out
    data = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
    size = np.array([len(words[i]) for i in short])
    at = np.concatenate([[0], np.cumsum(size)])
    deepest = int(size.max())
    wide = np.zeros((len(short), deepest), np.int16) - 1
    wide[np.repeat(np.arange(len(short)), size), np.arange(at[-1]) - np.repeat(at[:-1], size)] = data
    differs = np.ones((len(short), deepest), bool)
    differs[1:] = wide[1:] != wide[:-1]
    shared = np.where(differs.any(1), differs.argmax(1), deepest)  # bytes shared with the word before
    sums = _sums(data)
    node = np.zeros(len(short), np.int64)  # of each word, at the present depth
    score, count = [np.zeros(1)], [np.zeros(1, np.int64)]
    above: list[np.ndarray] = []  # of each node of a depth, its first word
    for depth in range(1, deepest + 1):
        new = (size >= depth) & (shared < depth)
        first = np.flatnonzero(new)
        index = np.cumsum(new) - 1
        top = np.full(len(first), -np.inf)
        tokens = np.zeros(len(first), np.int64)
        above.append(index)
        for length in range(1, min(depth, vocabulary.longest) + 1):
            parent = above[depth - length - 1][first] if depth > length else np.zeros(len(first), np.int64)
            found, value = vocabulary.find(_range_hash(sums, at[first] + depth - length, at[first] + depth))
            offer = [(found, value)]
            if length == 1:
                offer.insert(0, (np.arange(len(first)), np.full(len(first), PENALTY)))
            for who, gain in offer:
                total = score[depth - length][parent[who]] + gain
                pieces = count[depth - length][parent[who]] + 1
                better = (total > top[who]) | (total == top[who]) & (pieces < tokens[who])
                top[who[better]], tokens[who[better]] = total[better], pieces[better]
        score.append(top)
        count.append(tokens)
        ends = np.flatnonzero(size == depth)
        out[np.array(short)[ends]] = tokens[index[ends]]
        done = depth - vocabulary.longest  # no piece reaches back to it any more
        if done >= 0:
            score[done] = count[done] = node[:0]
        if done >= 1:
            above[done - 1] = node[:0]
    return out


class WordCounts:
    """Token counts of words by hash: a worker's bounded store of what the trie has answered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def totals(self, chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and words of each text of the chunk."""
        w = textvec.words(chunk, lower=False)
        distinct, first, which = textvec.distinct(w.hash)
        if len(self.known) > CACHED_WORDS:
            self.known, self.count = self.known[:0], self.count[:0]
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        here = place < len(self.known)
        new[here] = self.known[place[here]] != distinct[here]
        if new.any():
            raw = chunk.data.tobytes()
            counts = trie_counts(self.vocabulary, [MARK + raw[a:b] for a, b in zip(w.start[first[new]], w.end[first[new]], strict=True)])
            self.known, self.count = np.insert(self.known, place[new], distinct[new]), np.insert(self.count, place[new], counts)
            place = np.searchsorted(self.known, distinct)
        upto = np.concatenate([[0], np.cumsum(self.count[place][which], dtype=np.int64)]) if len(which) else np.zeros(1, np.int64)
        return np.diff(upto[w.of]), np.diff(w.of)


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of each text; one pass without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_keeps(("counts", model_path), lambda: WordCounts(Vocabulary(load_pieces(model_path))))
        for batch in batches:
            for chunk in textvec.chunks(batch.column(1)):
                tokens, words = store.totals(chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(words)), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_words long, n_tokens long")
