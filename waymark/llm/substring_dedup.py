"""Substring deduplication: near-duplicate passages across documents by compact windows of token min-hashes.

Tokens are five-word shingles. For each of HASHES hash orders, the token that is smallest in some stretch of LEAST tokens is
a node of the text's Cartesian tree; its compact window (left, centre, right) stands for all subsequences between left and
right that contain the centre, which all have that token as their min-hash. Two passages of LEAST tokens or more with
similarity s agree in an order with chance s.

1. Within each text, the windows of two orders are joined where their intervals share a stretch of LEAST tokens around both
   centres: the pair of min-hashes is the signature of all subsequences there. A passage of similarity 0.8 shares one of the
   PAIRS with a chance of 1 - (1 - 0.8^2)^3 = 0.95, and every longer one with far more, for it holds many stretches. Signatures
   are counted over all texts; those that only one text has are dropped. Every place of the others is kept.
2. Of a signature, each place in another text is verified against the first place. What that covers is settled. All pairs of
   places of two texts are verified at once, from the token hashes of the regions that their windows cover: around a place
   where LEAST tokens match with SIMILARITY or more, the longest stretch that does.
3. Signatures that still hold an open place go on without their first place. Up to LEVELS times their places are signed anew
   by fresh orders over the stretches around them (search within the group by min-hashes again), so that those which met by
   chance, say by a frequent line in different surroundings, part, and like ones meet others as first places. No group is
   emitted as pairs and no group is cut: each place is compared with one other per signature in each round.
4. Places that are open still go by the exact runs of LEAST tokens around them, among the places of their last groups, and are
   compared with the first place of the same run. So an exact repetition of WORDS words or more is always found, however much
   of it other texts have too; an edited one beside a common part may stay open after that.

Defined results: letter case and the amount of white space are ignored. Null and empty texts, and texts under 50 words, have no
passages of their own. Texts with the same words are one: all but the one with the smallest identifier (nulls last; of rows
repeated with it all but one) are reported as repeated as a whole if they have 50 words or more. Passages repeated only
within one text are not reported. A place whose tokens an earlier stretch covers is settled, so that of two overlapping
repeats fewer than LEAST tokens at the end of one may go unreported. Word numbers start at 0.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import fresh, materialize, spread_join

WORDS = 50
LEAST = WORDS - sh.SHINGLE + 1
HASHES = 6
#: Orders whose windows are joined; a signature is agreement in both.
PAIRS = ((0, 1), (2, 3), (4, 5))
SIMILARITY = 0.8
#: Places beyond which those of a key are dealt over tasks.
HOT_ROWS = 2000
#: Times that open places are signed anew.
LEVELS = 1
SALT = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 20) - 1)
#: Tokens of two passages that may stand apart from the diagonal and still match. A longer insertion in a passage that is
#: similar enough leaves LEAST tokens on one side at least.
DRIFT = 48


def orders(level: int) -> np.ndarray:
    return np.random.default_rng(3 + level).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


ORDERS = orders(0)


def _tree(value: list[int], place: list[int], first: int, last: int) -> tuple[list[int], list[int]]:
    """Left and right end of each node's window: how far it stays the smallest. Nodes in text order; equal values: the left one."""
    left, right, stack = [first] * len(value), [last] * len(value), []
    for k, v in enumerate(value):
        while stack and v < value[stack[-1]]:
            right[stack.pop()] = place[k] - 1
        if stack:
            left[k] = place[stack[-1]] + 1
        stack.append(k)
    return left, right


def _minima(s: sh.Shingles, order: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Values of an order, and for each start of a stretch of LEAST tokens within one text the place of its smallest."""
    n = len(s.hashes)
    y = s.hashes * order
    y = y & ~LOW | np.arange(n, dtype=np.uint64) & LOW  # the place tells equal tokens apart: the left one is smaller
    starts = np.arange(max(n - LEAST + 1, 0))
    starts = starts[s.text[: len(starts)] == s.text[LEAST - 1 :]] if len(starts) else starts
    if not len(starts):
        return y, starts
    low, width = y, 1
    while 2 * width <= LEAST:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < LEAST:
        low = np.minimum(low[: n - LEAST + 1], low[LEAST - width :][: n - LEAST + 1])
    return y, starts + ((low[starts] & LOW).astype(np.int64) - starts) % (1 << 20)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row counts."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    out = np.zeros(len(columns[0]), bool)
    out[0] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _windows(s: sh.Shingles, y: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of all compact windows in text order, with left and right ends (places in the block)."""
    centre = centre[_changes(centre)]
    text = s.text[centre]
    cuts = np.append(np.flatnonzero(_changes(text)), len(text))
    left, right = [], []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = _tree(y[centre[i:j]].tolist(), centre[i:j].tolist(), int(s.first[text[i]]), int(s.first[text[i] + 1]) - 1)
        left += a
        right += b
    return centre, np.array(left, np.int64), np.array(right, np.int64)


def compact_windows(s: sh.Shingles) -> tuple[np.ndarray, ...]:
    """text, order, left, centre, right (tokens within the text) of all windows of LEAST tokens or more."""
    out = []
    for f in range(HASHES):
        y, centre = _minima(s, ORDERS[f])
        c, left, right = _windows(s, y, centre)
        base = s.first[:-1][s.text[c]]
        out.append((s.text[c], np.full(len(c), f), left - base, c - base, right - base))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def signatures(s: sh.Shingles, places: bool = True, by: np.ndarray = ORDERS) -> tuple[np.ndarray, ...]:
    """text, signature, and if places centre, low, high (tokens within the text): the interval join of the windows of two orders.

    Along the starts of all stretches of LEAST tokens, the windows of each order follow each other; a pair of them shares
    such a stretch around both centres exactly where both are current at one start.
    """
    out = []
    for pair in PAIRS:
        sides = []
        for f in pair:
            y, centre = _minima(s, by[f])
            if not places or not len(centre):
                sides.append((centre, centre, centre))
                continue
            _, left, right = _windows(s, y, centre)
            where = np.cumsum(_changes(centre)) - 1
            sides.append((centre, left[where], right[where]))
        (c, l1, r1), (d, l2, r2) = sides
        keep = _changes(c, d)
        c, d, low, high = c[keep], d[keep], np.maximum(l1, l2)[keep], np.minimum(r1, r2)[keep]
        sig = sh.mix(sh.mix(s.hashes[c] + SALT[pair[0]]) + sh.mix(s.hashes[d] + SALT[pair[1]]))
        base = s.first[:-1][s.text[c]]
        out.append((s.text[c], sig.view(np.int64), c - base, low - base, high - base))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _doc_key(words: sh.Words) -> np.ndarray:
    """64-bit hash of the word sequence of each text."""
    d = sh.digests(words)
    return sh.mix(d[:, 0] + sh.mix(d[:, 1])).view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (hash of the text as it is), text in lower case."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def _keyed(rows: DataFrame) -> DataFrame:
    """id, t, doc (hash of the words), n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, words in sh.blocks(b.column(2)):
                n = len(words.first) - 1
                cols = [b.column(0).slice(row, n), b.column(1).slice(row, n), pa.array(_doc_key(words)), pa.array(np.diff(words.first))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "t", "doc", "n_words"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t long, doc long, n_words long")


def _signed(rows: DataFrame, whole: bool) -> DataFrame:
    """sig, doc, m (places) of all texts, each pair once; if whole, every place: sig, id, doc, place (centre, and tokens to both ends of the
    window, up to 65535, in one number)."""
    schema = f"sig long, id {rows.schema['id'].dataType.simpleString()}, doc long, place long" if whole else "sig long, doc long, m int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, words in sh.blocks(b.column(2)):
                text, sig, *places = signatures(sh.shingles(words), whole)
                doc = _doc_key(words)[text]
                if not whole:
                    order = np.lexsort((sig, text))
                    first = np.flatnonzero(_changes(text[order], sig[order]))
                    m = np.diff(np.append(first, len(order))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(sig[order[first]]), pa.array(doc[order[first]]), pa.array(m)], names=["sig", "doc", "m"])
                else:
                    centre, low, high = places
                    place = centre << 32 | np.minimum(centre - low, 0xFFFF) << 16 | np.minimum(high - centre, 0xFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array(sig), b.column(0).take(pa.array(row + text)), pa.array(doc), pa.array(place)], names=["sig", "id", "doc", "place"])

    return rows.mapInArrow(run, schema)


def _tokens(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, start, tokens (32-bit hashes, as bytes) of the region of each text in spans (doc, own, own_t, low, high)."""
    both = rows.join(spans, (F.col("t") == F.col("own_t")) & F.col("id").eqNullSafe(F.col("own"))).select("doc", "low", "high", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = b.column(1).to_numpy(), b.column(2).to_numpy()
            for row, words in sh.blocks(b.column(3)):
                s = sh.shingles(words)
                n = len(words.first) - 1
                short = (s.hashes >> np.uint64(32)).astype(np.uint32)
                tokens = [short[s.first[i] + low[row + i] : s.first[i] + high[row + i] + 1].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), b.column(1).slice(row, n), pa.array(tokens, pa.binary())], names=["doc", "start", "tokens"])

    return both.mapInArrow(run, "doc long, start int, tokens binary")


def _cut(low: str, high: str) -> Column:
    return F.substring("tokens", (F.col(low) - F.col("start")) * 4 + 1, (F.col(high) - F.col(low) + 1) * 4)


def _places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of tokens for _nearest: the distinct ones, the sorted pairs (token, place) as numbers, and how many places there are."""
    token, which = np.unique(b, return_inverse=True)
    return token, np.sort(which * len(b) + np.arange(len(b))), len(b)


def _nearest(index: tuple[np.ndarray, np.ndarray, int], own: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each token the place nearest to the one wanted (of two the left one) among its places, far below 0 without any."""
    token, pairs, n = index
    which = np.minimum(np.searchsorted(token, own), len(token) - 1)
    at = np.searchsorted(pairs, which * n + np.clip(want, 0, n - 1))
    out = np.full(len(own), -1 << 30)
    for k in (at - 1, at):
        pair = pairs[np.clip(k, 0, n - 1)]
        ok = (token[which] == own) & (k >= 0) & (k < n) & (pair // n == which)
        place = np.where(ok, pair % n, -1 << 30)
        out = np.where(np.abs(place - want) < np.abs(out - want), place, out)
    return out


class Diagonal:
    """Tokens of a that occur in b near one diagonal: place in b less place in a is about shift. Of equal tokens in b, the one
    nearest to the diagonal counts. m matches in n tokens have similarity m / (2 n - m), so n tokens are similar enough if
    matches less SHARE of tokens add up to 0 or more."""

    SHARE = 2 * SIMILARITY / (1 + SIMILARITY)

    def __init__(self, a: np.ndarray, b: np.ndarray, index: tuple, shift: int):
        self.a, self.index, self.shift = a, index, shift
        self.lo, self.hi = max(0, -shift - DRIFT), min(len(a) - 1, len(b) - 1 - shift + DRIFT)
        self.total: np.ndarray | None = None

    def matches(self, lo: int, hi: int) -> np.ndarray:
        want = np.arange(lo, hi + 1) + self.shift
        out = _nearest(self.index, self.a[lo : hi + 1], want)
        out[np.abs(out - want) > DRIFT] = -1
        return out

    def promising(self, p: np.ndarray) -> np.ndarray:
        """Those of the places p (sorted) around which LEAST tokens match well enough by themselves."""
        good = np.zeros(len(p), bool)
        for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p) > 2 * LEAST) + 1):
            lo, hi = max(self.lo, int(p[part[0]]) - LEAST + 1), min(self.hi, int(p[part[-1]]) + LEAST - 1)
            if hi - lo + 1 < LEAST:
                continue
            flag = self.matches(lo, hi) >= 0
            total = np.concatenate([[0], np.cumsum(flag)])
            ok = np.concatenate([[0], np.cumsum(total[LEAST:] - total[:-LEAST] >= self.SHARE * LEAST - 1e-9)])
            at = p[part] - lo
            first, last = np.clip(at - LEAST + 1, 0, len(ok) - 1), np.clip(at + 1, 0, len(ok) - 1)
            good[part] = (ok[last] > ok[first]) & flag[np.clip(at, 0, len(flag) - 1)]
        return p[good]

    def stretch(self, p: int) -> tuple[int, int, int, int, float] | None:
        """The longest similar stretch that contains p: start and end in a, start and end in b, similarity."""
        if self.total is None:
            self.match = self.matches(self.lo, self.hi)
            self.flag = self.match >= 0
            self.total = np.concatenate([[0.0], np.cumsum(self.flag - self.SHARE)])
        k = p - self.lo
        floor = np.minimum.accumulate(self.total[: k + 1])  # the first start whose sum is low enough is the best
        starts = np.searchsorted(-floor, -(self.total[k + 1 :] + 1e-9), "left")
        lengths = np.where(starts <= k, k + 1 + np.arange(len(starts)) - starts, 0)
        e = int(lengths.argmax())
        i, j = int(starts[e]), k + 1 + e
        inside = np.flatnonzero(self.flag[i:j]) + i if lengths[e] >= LEAST else []
        if not len(inside):
            return None
        i, j, m = int(inside[0]), int(inside[-1]) + 1, len(inside)
        spots = self.match[inside]
        return (self.lo + i, self.lo + j - 1, int(spots.min()), int(spots.max()), m / (2 * (j - i) - m)) if j - i >= LEAST else None


CHECKED = "doc long, first long, start long, end long, first_start long, first_end long, similarity double, key long"
#: Places whose diagonals differ by less are looked at on one of them.
SIDE_BY_SIDE = 8


def _hits(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Stretches (start, end, first_start, first_end in tokens, similarity) around the places (p, q), and which places lie in none."""
    out: list[tuple] = []
    index, shift = _places(y), q - p
    order = np.lexsort((p, shift))
    cuts = [0]
    while cuts[-1] < len(order):
        cuts.append(int(np.searchsorted(shift[order], shift[order[cuts[-1]]] + SIDE_BY_SIDE, "right")))
    lost = np.ones(len(p), bool)
    for at, upto in sorted(zip(cuts[:-1], cuts[1:], strict=True), key=lambda c: c[0] - c[1]):  # the fullest diagonal first
        left = order[at:upto]
        left = left[lost[left]]
        if not len(left):
            continue
        d, reach = Diagonal(x, y, index, int(shift[left[len(left) // 2]])), -1
        for c in d.promising(np.unique(p[left])).tolist():
            hit = d.stretch(c) if c > reach else None
            if hit:
                out.append(hit)
                reach = hit[1]
                lost &= (p < hit[0]) | (p > reach)
    return out, lost


def _checked(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """Verified stretches of the candidates (key, doc, centre, low, high and the same of the first place), in words, and those
    candidates that lie in none, with their key and the centre as start. Each pair of texts is verified once."""
    ends = [F.min(c).alias(c) for c in ("low", "first_low")] + [F.max(c).alias(c) for c in ("high", "first_high")]
    spots = F.collect_list(F.struct(F.col("centre").alias("p"), F.col("first_centre").alias("q"), "key")).alias("spots")
    pairs = materialize(candidates.repartition("doc", "first").groupBy("doc", "first").agg(spots, *ends), "pairs")
    a = pairs.join(tokens, "doc").select("doc", "first", "low", "first_low", "first_high", _cut("low", "high").alias("a"), "spots")
    b = tokens.withColumnRenamed("doc", "first")
    counted = pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    both = spread_join(a, b, "first", counted, pairs.count()).select("doc", "first", "low", "first_low", "a", _cut("first_low", "first_high").alias("b"), "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(6)
            p, q, key = (spots.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            ends = np.concatenate([[0], np.cumsum(spots.value_lengths().to_numpy())])
            low, first_low = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            rows = []
            for i, (doc, first) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint32) for k in (4, 5))
                own = slice(ends[i], ends[i + 1])
                a0, b0 = int(low[i]), int(first_low[i])
                found, lost = _hits(x, y, p[own] - a0, q[own] - b0)
                rows += [(doc, first, s + a0, e + a0 + sh.SHINGLE, t + b0, u + b0 + sh.SHINGLE, v, None) for s, e, t, u, v in found]
                rows += [(doc, first, c, None, None, None, None, k) for c, k in zip(p[own][lost].tolist(), key[own][lost].tolist(), strict=True)]
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()]
            names = [c.split()[0] for c in CHECKED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return materialize(both.mapInArrow(run, CHECKED), "checked")


def _signed_anew(left: DataFrame, tokens: DataFrame, level: int) -> DataFrame:
    """Places (key, id, doc, centre, low, high, open) under new keys: the old one with each signature, by fresh orders, of the
    stretches of LEAST tokens around the centre."""
    lo, hi = F.greatest("low", F.col("centre") - (LEAST - 1)), F.least("high", F.col("centre") + (LEAST - 1))
    near = left.withColumns({"from": lo, "upto": hi}).join(tokens, "doc").select(*left.columns, _cut("from", "upto").alias("tokens"))
    by, names = orders(level), left.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                column = part.column(part.num_columns - 1)
                count = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                flat = np.frombuffer(b"".join(column.to_pylist()), np.uint32).astype(np.uint64)
                s = sh.Shingles(sh.mix(flat), np.concatenate([[0], np.cumsum(count)]), np.repeat(np.arange(len(count)), count))
                text, sig, *_ = signatures(s, False, by)
                old = part.column(0).to_numpy().view(np.uint64)[text]
                key = sh.mix(old * np.uint64(0x9E3779B97F4A7C15) + sig.view(np.uint64)).view(np.int64)
                rest = [part.column(k).take(pa.array(text)) for k in range(1, part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *rest], names=names)

    return near.mapInArrow(run, left.schema).dropDuplicates(["key", "doc", "centre"])


def _exact_runs(left: DataFrame, tokens: DataFrame) -> DataFrame:
    """The same places under exact keys: a hash of each run of LEAST tokens that contains a centre, with the run as region."""
    lo, hi = F.greatest("low", F.col("centre") - (LEAST - 1)), F.least("high", F.col("centre") + (LEAST - 1))
    near = left.groupBy("id", "doc", lo.alias("from"), hi.alias("upto")).agg(F.max("open").alias("open"))
    near = near.join(tokens, "doc").select("id", "doc", "from", "open", _cut("from", "upto").alias("tokens"))
    names = left.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                column = part.column(4)
                count = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                flat = sh.mix(np.frombuffer(b"".join(column.to_pylist()), np.uint32).astype(np.uint64))
                powers = np.full(len(flat) + 1, SALT[0], np.uint64).cumprod()
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * powers[:-1])])
                runs = np.maximum(count - LEAST + 1, 0)
                text = np.repeat(np.arange(len(count)), runs)
                nth = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
                start = np.repeat(np.cumsum(count) - count, runs) + nth
                # Shifted to one power, equal runs have equal sums wherever they stand.
                key = sh.mix((sums[start + LEAST] - sums[start]) * powers[len(flat) - start]).view(np.int64)
                low = np.repeat(part.column(2).to_numpy(zero_copy_only=False).astype(np.int32), runs) + nth.astype(np.int32)
                own = [part.column(k).take(pa.array(text)) for k in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(key), own[0], own[1], *[pa.array((low + x).astype(np.int32)) for x in (LEAST // 2, 0, LEAST - 1)], own[2]], names=names)

    out = near.mapInArrow(run, left.schema)
    return out.groupBy(*[c for c in names if c != "open"]).agg(F.max("open").alias("open")).select(*names)


def _stretches(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Verified stretches (doc, first, start, end, first_start, first_end in words, similarity) of the texts (rows), of which
    names (doc, id, t) holds the first row of each."""
    common = _signed(rows, False).groupBy("sig").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.sum("m").alias("n"))
    common = materialize(common.where("a <> z").select(F.col("sig"), "n"), "common")
    places = spread_join(_signed(rows, True), common.select("sig"), "sig", common)
    # Copies of one text sign alike.
    places = places.groupBy("sig", "doc", "place").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("own"))
    centre = F.shiftright("place", 32)
    ends = [(centre - F.shiftright("place", 16).bitwiseAND(0xFFFF)).cast("int").alias("low"), (centre + F.col("place").bitwiseAND(0xFFFF)).cast("int").alias("high")]
    at = materialize(places.select(F.col("sig").alias("key"), F.col("own.id").alias("id"), "doc", centre.cast("int").alias("centre"), *ends, F.lit(True).alias("open")), "places")

    spans = at.groupBy("doc").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(names.withColumnsRenamed({"id": "own", "t": "own_t"}), "doc")
    # Rows repeated with one identifier and text give the same region again.
    tokens = materialize(_tokens(rows, spans).groupBy("doc").agg(F.first("start").alias("start"), F.first("tokens").alias("tokens")), "tokens")

    done = []
    for level in range(LEVELS + 2):  # the last one by exact runs
        place = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc", "centre", "low", "high")
        firsts = at.groupBy("key").agg(F.min(place).alias("f"), F.min("doc").alias("a"), F.max("doc").alias("z"), F.max("open").alias("any"), F.count(F.lit(1)).alias("n"))
        of = {"first": "doc", "first_centre": "centre", "first_low": "low", "first_high": "high"}
        firsts = materialize(firsts.where("a <> z and any").select("key", "n", *[F.col(f"f.{v}").alias(k) for k, v in of.items()]), "firsts")
        checked = _checked(spread_join(at.where("open"), firsts.drop("n"), "key", firsts, hot_rows=HOT_ROWS).where("doc <> first"), tokens)
        done.append(checked.where("key is null").drop("key"))
        covered = functools.reduce(DataFrame.union, done).groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        inside = F.exists("spans", lambda v: (v["start"] <= F.col("centre")) & (F.col("centre") + sh.SHINGLE <= v["end"]))
        lost = checked.where("key is not null").select("key", "doc", F.col("start").cast("int").alias("centre"))
        lost = materialize(lost.join(covered, "doc", "left").where(~F.coalesce(inside, F.lit(False))).select("key", "doc", "centre").distinct(), "open")
        if level > LEVELS or lost.isEmpty():
            break
        active = firsts.join(lost.select("key").distinct(), "key", "left_semi")
        left = spread_join(at.drop("open"), active.drop("n", "first_low", "first_high"), "key", active, hot_rows=HOT_ROWS).where("doc <> first or centre <> first_centre").drop("first", "first_centre")
        left = left.join(lost.withColumn("open", F.lit(True)), ["key", "doc", "centre"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        left = left.select(*at.columns)
        at = materialize(_exact_runs(left, tokens) if level == LEVELS else _signed_anew(left, tokens, level + 1), "places")
    return functools.reduce(DataFrame.union, done)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: id, t (hash of the text), start, end, first_id, first_start, first_end (words, ends
    exclusive), similarity, whole (a further text with the same words)."""
    rows = _rows(docs, id_col, text_col)
    keyed = materialize(_keyed(rows), "keyed")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "t")
    originals = materialize(keyed.groupBy("doc").agg(F.min(place).alias("best"), F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("n")), "originals")
    names = originals.select("doc", F.col("best.id").alias("id"), F.col("best.t").alias("t"))

    hits = _stretches(rows, names).groupBy("doc", "first", "start", "end").agg(F.max(F.struct("similarity", "first_start", "first_end")).alias("h"))
    hits = materialize(hits.join(names, "doc"), "hits")
    hits = spread_join(hits, names.select(F.col("doc").alias("first"), F.col("id").alias("first_id")), "first", rows=hits.count())
    parts = hits.select("id", "t", "start", "end", "first_id", "h.first_start", "h.first_end", "h.similarity", F.lit(False).alias("whole"))
    # Further texts with the same words: repeated as a whole.
    many = originals.where((F.col("n") > 1) & (F.col("n_words") >= WORDS)).select("doc", "best", "n")
    more = keyed.groupBy("doc", "id", "t", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    more = spread_join(more, many.drop("n"), "doc", many, keyed.count())
    more = more.withColumn("more", F.col("copies") - F.when(place == F.col("best"), 1).otherwise(0)).where("more > 0").withColumn("more", F.explode(F.sequence(F.lit(1).cast("long"), "more")))
    zero, end = F.lit(0).cast("long"), F.col("n_words")
    return parts.unionByName(more.select("id", "t", zero.alias("start"), end.alias("end"), F.col("best.id").alias("first_id"), zero.alias("first_start"), end.alias("first_end"), F.lit(1.0).alias("similarity"), F.lit(True).alias("whole")))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of repeated passages (the first occurrence stays); what is left of a text is joined by spaces.
    Rows repeated with one identifier and text keep it alike."""
    key = fresh(docs, "wm_t", "wm_id", "wm_null", "wm_spans")
    named = lambda i, t: [t.alias(key[0]), F.coalesce(i.cast("string"), F.lit("")).alias(key[1]), i.isNull().alias(key[2])]
    found = passages(docs, id_col, text_col).where(~(F.col("whole") & F.col("id").eqNullSafe(F.col("first_id"))))
    spans = found.select(*named(F.col("id"), F.col("t")), F.struct("start", "end").alias("s")).groupBy(*key[:3]).agg(F.collect_set("s").alias(key[3]))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists(F.col(key[3]), lambda s: (s["start"] <= i) & (i < s["end"])))
    out = docs.select("*", *named(F.col(id_col), F.xxhash64(text_col))).join(spans, key[:3], "left")
    text = F.when(F.col(key[3]).isNull(), F.col(text_col)).otherwise(F.array_join(kept, " "))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
