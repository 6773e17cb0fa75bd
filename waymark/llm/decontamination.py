"""Benchmark decontamination: Wu-Manber search for the word windows of test items in whole texts (Arrow, no shuffle).

The patterns are the windows of WINDOW consecutive words of each item; an item of fewer words is one pattern. Patterns of one
length share a table: the hash of a block of two words gives how far the search may jump (the shift), and where that is zero,
the hash of the pattern's last block gives the bucket of patterns to test. Words of candidates are compared by their hashes
and then byte by byte, so nothing is reported that isn't there. A chunk of texts is searched in many lanes at once, each lane
jumping by its own shifts.

The test items are dealt over blocks of at most BLOCK_BYTES of text by a hash, and one block at a time is broadcast: its size is
bounded whatever the benchmark's is. With several blocks the texts are read once for each, and what was found so far is written
to the shared folder in between.

Defined results: a null or empty text has no words and no hit; a text of any length is searched whole. Items with equal windows
are all reported. A null item identifier hits words, but is no item to report. Repeated rows, and null or repeated document
identifiers, are answered row by row. Empty tables give empty or unhit results; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, text_of

#: Words of a window.
WINDOW = 10
#: Text bytes of the test items that are searched for at once, and of the documents in one chunk.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20

#: By byte: the lower case of A to Z, and whether a byte belongs to a word (digits, letters and all of non-ASCII characters).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

#: An odd base of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPANS = "array<struct<start:long,end:long>>"


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, n of them at least."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(1 << max(n - 1, 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


class Words:
    """The words of texts: data (lower-cased bytes), start, end (bytes), hash, and first (the number of words before each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = LOWER[data]
        inside = IN_WORD[self.data]
        # A word ends with its text: cut marks the bytes at which a text begins.
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        self.start = np.flatnonzero(after & (~before | cut))
        self.end = np.flatnonzero(before & (~after | cut))
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n + 1)[:n], out=sums[1:])
        self.hash = (sums[self.end] - sums[self.start]) * powers(INVERSE, n + 1)[self.start]
        self.hash ^= self.hash >> np.uint64(29)
        self.first = np.searchsorted(self.start, offsets)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[a_start:a_start + length] equals b[b_start:b_start + length], for each of many; lengths are positive."""
    if not len(length):
        return np.zeros(0, bool)
    first = np.cumsum(length) - length
    k = np.arange(first[-1] + length[-1])
    equal = a[np.repeat(a_start - first, length) + k] == b[np.repeat(b_start - first, length) + k]
    return np.logical_and.reduceat(equal, first)


class Table:
    """Shifts and buckets of the patterns of one length; at: each pattern's first word in words."""

    def __init__(self, words: Words, at: np.ndarray, length: int) -> None:
        self.words, self.length, self.block = words, length, min(2, length)
        self.bits = np.uint64(64 - min(22, max(12, int(8 * len(at) * length).bit_length())))
        last = [self._code(words.hash, at + k) for k in range(self.block - 1, length)]
        self.shift = np.full(1 << (64 - int(self.bits)), length - self.block + 1, np.int64)
        for k, code in enumerate(last):
            np.minimum.at(self.shift, code, len(last) - 1 - k)
        order = np.argsort(last[-1], kind="stable")
        self.at, self.pattern = at[order], order
        self.bucket = np.searchsorted(last[-1][order], np.arange(len(self.shift) + 1))

    def _code(self, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the block whose last word is at end."""
        x = hashes[end] if self.block == 1 else hashes[end - 1] * np.uint64(0xD6E8FEB86659FD93) + hashes[end]
        return ((x * np.uint64(0xA0761D6478BD642F)) >> self.bits).astype(np.int64)

    def find(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences: first word in the text, and number of the pattern."""
        n, m = len(text.hash), self.length
        lane = max(16 * m, n // 4096 + 1)
        p = np.arange(m - 1, n, lane)
        stop = np.minimum(p + lane, n)
        ends = []
        while len(p):
            code = self._code(text.hash, p)
            shift = self.shift[code]
            ends.append((p[shift == 0], code[shift == 0]))
            p = p + np.maximum(shift, 1)
            p, stop = p[p < stop], stop[p < stop]
        end, code = (np.concatenate(x) for x in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 2
        # Windows that reach over the end of a text are none.
        start = end - m + 1
        whole = np.searchsorted(text.first, start, "right") == np.searchsorted(text.first, end, "right")
        start, code = start[whole], code[whole]
        size = self.bucket[code + 1] - self.bucket[code]
        start, slot = np.repeat(start, size), np.repeat(self.bucket[code] - np.cumsum(size) + size, size) + np.arange(size.sum())
        for k in range(m):
            equal = text.hash[start + k] == self.words.hash[self.at[slot] + k]
            start, slot = start[equal], slot[equal]
        for k in range(m):
            a, b = start + k, self.at[slot] + k
            length = text.end[a] - text.start[a]
            equal = length == self.words.end[b] - self.words.start[b]
            equal[equal] = same_bytes(text.data, text.start[a][equal], self.words.data, self.words.start[b][equal], length[equal])
            start, slot = start[equal], slot[equal]
        return start, self.pattern[slot]


class Patterns:
    """The windows of test items, given as (identifier as text or null, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        texts = [(t or "").encode() for _, t in items]
        words = Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])[:-1])
        count = np.diff(np.append(words.first, len(words.hash)))
        #: Identifiers in the order of texts; of each item, the place of its identifier there.
        self.names = sorted({i for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(self.names)}
        own = np.array([place.get(i, -1) for i, _ in items], np.int64)
        self.tables: list[tuple[Table, np.ndarray]] = []
        for m in sorted({min(window, c) for c in count.tolist() if c}):
            some = np.flatnonzero(count >= m if m == window else count == m)
            each = count[some] - m + 1
            at = np.repeat(words.first[some] - np.cumsum(each) + each, each) + np.arange(each.sum())
            self.tables.append((Table(words, at, m), np.repeat(own[some], each)))

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all occurrences: first word, word after the last, and distinct (text, item place)."""
        starts, ends, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for table, owner in self.tables:
            start, pattern = table.find(text)
            starts.append(start)
            ends.append(start + table.length)
            doc = np.searchsorted(text.first, start, "right") - 1
            item = owner[pattern]
            items.append(np.unique((doc * len(self.names) + item)[item >= 0]))
        pairs = np.unique(np.concatenate(items))
        width = max(1, len(self.names))
        return np.concatenate(starts), np.concatenate(ends), pairs // width, pairs % width


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of rows that hold about CHUNK_BYTES; a longer text is a run of its own."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
        i = j


def _spans(hit: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Of each text the runs of hit words, counted from its first word."""
    edges = np.concatenate(([False], hit, [False]))
    cut = np.zeros(len(edges), bool)
    cut[first + 1] = True  # a run ends with its text
    start = np.flatnonzero(edges[1:-1] & (~edges[:-2] | cut[1:-1]))
    end = np.flatnonzero(edges[1:-1] & (~edges[2:] | cut[2:])) + 1
    doc = np.searchsorted(first, start, "right") - 1
    out: list[list[dict]] = [[] for _ in first]
    for d, s, e, f in zip(doc.tolist(), start.tolist(), end.tolist(), first[doc].tolist()):
        out[d].append({"start": s - f, "end": e - f})
    return out


def _searched(rows: DataFrame, text: str, names: list[str], items: list[tuple], window: int) -> DataFrame:
    """rows with three columns set: number of words, spans of hit words, sorted identifiers of items; earlier findings are kept."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    words, spans, found = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(shared.value, window)
        for b in batches:
            n_words, hits, ids = [], [], []
            old_spans, old_ids = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (spans, found))
            for i, j, text_words in _chunks(b.column(b.schema.get_field_index(text))):
                n = len(text_words.hash)
                first = text_words.first
                start, end, doc, item = patterns.search(text_words)
                known = [(f + s["start"], f + s["end"]) for f, old in zip(first.tolist(), old_spans[i:j]) for s in old or ()]
                start, end = (np.concatenate((x, [k[e] for k in known])).astype(np.int64) for e, x in enumerate((start, end)))
                hit = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
                n_words += np.diff(np.append(first, n)).tolist()
                hits += _spans(hit, first)
                mine: list[list[str]] = [list(old or ()) for old in old_ids[i:j]]
                for d, k in zip(doc.tolist(), item.tolist()):
                    mine[d].append(patterns.names[k])
                ids += [sorted(set(x)) for x in mine]
            columns = {words: pa.array(n_words, pa.int64()), spans: pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), found: pa.array(ids, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, b.column(k)) for k, f in enumerate(b.schema)], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def search(docs: DataFrame, benchmark: DataFrame, names: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns names[0] (words of the text), names[1] (spans of hit words, from the first one on, the end not
    included) and names[2] (identifiers of the items found, as texts in order)."""
    text, block = fresh([*docs.columns, *names], "wm_text", "wm_block")
    rows = docs.withColumn(text, text_of(text_col)).withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.array().cast(SPANS), names[2]: F.array().cast("array<string>")})
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.lit(32))).first()[0] or 0
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    if blocks > 1:  # written once, a folder for each block
        items = materialize(items.withColumn(block, F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")), "benchmark-blocks")
    for b in range(blocks):
        some = items if blocks == 1 else items.where(F.col(block) == b).drop(block)
        rows = _searched(rows if b == 0 else materialize(rows, "searched"), text, names, [tuple(r) for r in some.collect()], window)
    return rows.drop(text)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, n_words, spans, items of every row of docs."""
    return search(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, ["n_words", "spans", "items"], **how).drop("text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    names = fresh(docs, "wm_words", "wm_spans", "wm_items")
    return search(docs, benchmark, names, text_col, **how).where(F.size(names[1]) == 0).drop(*names)
