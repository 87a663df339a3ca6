"""Vectorised text primitives over Arrow buffers: words, word hashes, shingles.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, so that UTF-8 needs no decoding. All functions work on one
``Chunk``: consecutive texts whose bytes lie together. A chunk holds whole texts, ``CHUNK_ROWS`` at most, and
about ``CHUNK_BYTES`` bytes, more only where a single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 512

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
END_TOKEN = np.uint64(0x5851F42D4C957F2D)
"""The hash that stands for the end of a text."""


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data - np.uint8(0x09) < 5)


def _letter(data: np.ndarray) -> np.ndarray:
    return (data | np.uint8(0x20)) - np.uint8(0x61) < 26


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
        if size > 8 * CHUNK_BYTES:  # a very long text: not kept
            _powers.pop(kind)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each text begins (one more entry: the end)."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string column in chunks; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(lo + CHUNK_ROWS, max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1))
        yield Chunk(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """The words of a chunk: byte ranges, 64-bit hashes, and ``of``: the first word of each text (one more: the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, where one of each stands, and for each key its place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return data + ((data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5))


def before_punctuation(data: np.ndarray) -> np.ndarray:
    """Where an ASCII letter is followed by an ASCII character that is neither letter, digit nor white space."""
    out = np.zeros(len(data), bool)
    letter = _letter(data)
    out[1:] = letter[:-1] & ~letter[1:] & (data[1:] - np.uint8(0x21) < 94) & ~(data[1:] - np.uint8(0x30) < 10)
    return out


def words(chunk: Chunk, lower: bool = True, cut: np.ndarray | None = None) -> Words:
    """Splits the texts at white space, and before the bytes marked in ``cut``; with ``lower``, A-Z count as a-z."""
    data, at = chunk.data, chunk.at
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    inside = ~_space(data)
    first = np.empty(n + 1, bool)
    first[0] = first[n] = True
    first[1:n] = ~inside[:-1]
    first[at] = True
    if cut is not None:
        first[:n] |= cut
    start = np.flatnonzero(inside & first[:n])
    last = np.empty(n, bool)
    last[n - 1] = True
    last[:-1] = ~inside[1:]
    cuts = at[1:] - 1
    last[cuts[cuts >= 0]] = True
    if cut is not None:
        last[:-1] |= cut[1:]
    end = np.flatnonzero(inside & last) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[lowered(data) if lower else data] * _power("up", n)[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power("down", n)[start])
    return Words(start, end, hashes, np.searchsorted(start, at))


def windows(hashes: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows within each text, and ``of``; a text of 1 to k-1 words has one: all its words."""
    n = np.diff(of)
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            rolled += hashes[j : len(hashes) - k + 1 + j] * factor[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(starts[-1]) - starts[row] + of[row]
    out = np.empty(starts[-1], np.uint64)
    whole = (n >= k)[row]
    out[whole] = rolled[at[whole]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = np.uint64(0)
        for j, h in enumerate(hashes[of[i] : of[i + 1]]):
            with np.errstate(over="ignore"):
                x = np.uint64((int(x) + int(h) * int(factor[j])) & (2**64 - 1))
        out[starts[i]] = mix(np.array([x ^ np.uint64(n[i])]))[0]
    return out, starts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    steps = np.ones(total, np.int64)
    steps[0] = starts[0]
    ends = np.cumsum(lengths)[:-1]
    steps[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)
