"""Simple-8b coding of unsigned ids: 64-bit words whose selector says how many ids of how many bits follow.

A list of ids is cut into blocks of ``BLOCK`` ids, each a sequence of whole words of its own, so that all blocks of a
list are packed, and unpacked, side by side with array operations; the words before each block are the block offsets.
An id of more than 60 bits is an escape: a word with the escape selector, then the id as a raw word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
#: Ids in a word and bits of each, by selector (the coding's public table without its runs of zeros).
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
_U = np.uint64


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits needed for each id, 1 at least, exact for all 64-bit values."""
    high, low = (ids >> _U(32)).astype(np.float64), (ids & _U(0xFFFFFFFF)).astype(np.float64)
    return np.maximum(np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]), 1).astype(np.int8)


def _selectors(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """At each place the selector that packs most ids if a word begins there; ``left``: ids to the end of the block."""
    n = len(bits)
    widest = np.empty(n, np.int8)
    best = np.full(n, len(COUNTS) - 1, np.int8)
    padded = np.concatenate([bits, np.zeros(64, np.int8)])
    widest[:] = bits
    done = 1
    for s in range(len(COUNTS) - 1, -1, -1):
        for j in range(done, COUNTS[s]):
            np.maximum(widest, padded[j : j + n], out=widest)
        done = int(COUNTS[s])
        fits = widest <= BITS[s]
        if not fits.any():  # nor will any longer run fit in fewer bits
            break
        best[fits & (left >= done)] = s
    best[bits > 60] = ESCAPE
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a list of ids, and the words before each block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)
    sel = _selectors(bit_lengths(ids), left)
    size = np.where(sel == ESCAPE, 1, COUNTS[np.minimum(sel, len(COUNTS) - 1)])
    at, where, begins = np.arange(blocks) * BLOCK, [], []
    live = np.arange(blocks)
    while len(live):
        begins.append(at)
        where.append(live)
        at = at + size[at]
        more = at < ends[live]
        at, live = at[more], live[more]
    begins = np.concatenate(begins)
    block = np.concatenate(where)
    order = np.argsort(begins, kind="stable")
    begins, block = begins[order], block[order]
    s = sel[begins]
    width = np.where(s == ESCAPE, 2, 1)
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint64)
    for k in np.unique(s):
        here = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[place[here]] = _U(ESCAPE) << _U(60)
            out[place[here] + 1] = ids[begins[here]]
            continue
        word = np.full(len(here), _U(k) << _U(60), np.uint64)
        for j in range(COUNTS[k]):
            word |= ids[begins[here] + j] << _U(j * BITS[k])
        out[place[here]] = word
    return out, place[np.searchsorted(block, np.arange(blocks))].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``encode``. Escapes are found block by block, all blocks at a time."""
    if not n:
        return np.zeros(0, np.uint64)
    words = np.ascontiguousarray(words, np.uint64)
    sel = (words >> _U(60)).astype(np.int8)
    head = np.ones(len(words), bool)
    if (sel == ESCAPE).any() or (sel == ESCAPE - 1).any():  # a raw word looks like any other: walk from the block starts
        head[:] = False
        at, ends = offsets.astype(np.int64), np.concatenate([offsets[1:], [len(words)]]).astype(np.int64)
        while len(at):
            head[at] = True
            at = at + np.where(sel[at] == ESCAPE, 2, 1)
            more = at < ends
            at, ends = at[more], ends[more]
    begins = np.flatnonzero(head)
    s = sel[begins]
    size = np.where(s == ESCAPE, 1, COUNTS[np.minimum(s, len(COUNTS) - 1)])
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint64)
    for k in np.unique(s):
        here = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[place[here]] = words[begins[here] + 1]
            continue
        mask = _U((1 << int(BITS[k])) - 1)
        for j in range(COUNTS[k]):
            out[place[here] + j] = (words[begins[here]] >> _U(j * BITS[k])) & mask
    if len(out) != n:
        raise ValueError(f"{len(out)} ids decoded, {n} announced")
    return out
