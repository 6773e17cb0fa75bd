"""Words and five-word shingles of many texts at once, as 64-bit hashes (numpy, inside tasks).

Texts lie end to end in one Arrow buffer. Each byte gets a random 64-bit value times a power of its place; sums over words,
divided by the power of their start, are hashes of the words that do not depend on the place. No step is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes hashed at a time; a text, or a stretch of one between white space, may be longer.
BLOCK = 1 << 20
U = np.uint64
_random = np.random.default_rng(5)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_random.integers(1 << 60, 1 << 62)) * 8 + 3
UNBASE = pow(BASE, -1, 1 << 64)
PLACE = _random.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base & (1 << 64) - 1))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_tables = {b: _powers(b, BLOCK + 1) for b in (BASE, UNBASE)}


def powers(base: int, n: int) -> np.ndarray:
    return _tables[base][:n] if n <= BLOCK + 1 else _powers(base, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit values with well-spread bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Word hashes of consecutive texts: those of text i are hashes[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    first: np.ndarray


def _hash_block(data: np.ndarray, cuts: np.ndarray) -> Words:
    """cuts: where texts begin, and the end."""
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = cuts[:-1][cuts[:-1] < len(data)]
    begin[at] = inside[at]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[data] * powers(BASE, len(data)))])
    hashes = mix((sums[ends + 1] - sums[starts]) * powers(UNBASE, len(data))[starts])
    return Words(hashes, np.searchsorted(starts, cuts))


def blocks(column: pa.Array):
    """(first row, Words) for stretches of rows of a string column, about BLOCK bytes each; nulls have no words."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= 2 * BLOCK:
            yield row, _hash_block(data[lo:hi], offsets[row : last + 1] - lo)
        else:  # one long text, in stretches that end at white space
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + BLOCK)
                while to < hi and not SPACE[data[to]]:
                    step = np.flatnonzero(SPACE[data[to : to + BLOCK]])
                    to = min(hi, to + (int(step[0]) if len(step) else BLOCK))
                parts.append(_hash_block(data[at:to], np.array([0, to - at])).hashes)
                at = to
            hashes = np.concatenate(parts)
            yield row, Words(hashes, np.array([0, len(hashes)]))
        row = last


@dataclass
class Shingles:
    """Shingle hashes of consecutive texts, like Words. A text of one to four words has one shingle, of all of them."""

    hashes: np.ndarray
    first: np.ndarray
    text: np.ndarray  # the text of each shingle


def shingles(words: Words, size: int = SHINGLE) -> Shingles:
    h, counts = words.hashes, np.diff(words.first)
    padded = np.concatenate([h, np.zeros(size, U)])
    rolled = np.zeros(len(h), U)
    for k in range(size):
        rolled += padded[k : k + len(h)] * PLACE[k % 8] * U(2 * (k // 8) + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(h)) - words.first[:-1][text]
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = h[words.first[i] : words.first[i + 1]]
        rolled[words.first[i]] = (own * PLACE[: len(own)]).sum() + U(len(own))
    keep = within < n[text]
    return Shingles(mix(rolled[keep]), np.concatenate([[0], np.cumsum(n)]), text[keep])


def labelled(s: Shingles) -> np.ndarray:
    """Shingle hashes that also tell the first, second, ... occurrence within a text apart."""
    key = mix(s.hashes + mix(s.text.astype(U) + U(1)))
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    occurrence = np.zeros(len(key), U)
    if len(again):
        again = np.unique(again)
        where = np.searchsorted(again, key)
        where[where == len(again)] = 0
        at = np.flatnonzero(again[where] == key)
        at = at[np.argsort(key[at], kind="stable")]
        group = np.concatenate([[0], np.flatnonzero(key[at][1:] != key[at][:-1]) + 1])
        occurrence[at] = np.arange(len(at)) - np.repeat(group, np.diff(np.append(group, len(at))))
    return mix(s.hashes + occurrence * U(0x9E3779B97F4A7C15))


def digests(words: Words) -> np.ndarray:
    """Two order-sensitive 64-bit hashes of the word sequence of each text, in 16 bytes."""
    counts = np.diff(words.first)
    out = np.zeros((len(counts), 2), U)
    if len(words.hashes):
        place = (np.arange(len(words.hashes)) - np.repeat(words.first[:-1], counts)).astype(U)
        full = counts > 0
        for k in range(2):
            values = mix(words.hashes + mix(place + U(1) << U(1 + k)))
            out[full, k] = np.add.reduceat(values, words.first[:-1][full])
    out[:, 1] ^= counts.astype(U)
    return out
