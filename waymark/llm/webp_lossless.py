"""Lossless WebP for one image: a decoder of the whole bit stream and an encoder that the media column writes with.

Decoding: prefix codes (simple and normal), back-references, colour cache, several code groups, and the inverses of the
predictor, cross-colour, subtract-green and palette transforms. Streams under one code group are decoded without a step per bit: the literal at every bit
position of a block is looked up at once, then the chain of pixels is followed; only back-references and cache indices take a
step each. Files are decoded together where they are many: pixels of all images under one predictor mode are summed up at once.
Images are arrays of shape (height, width, 4), red, green, blue, alpha.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections import OrderedDict

import numpy as np

#: Order in which code lengths of the code length code are stored (fixed values of the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
N_LENGTH, N_DISTANCE = 24, 40
MAX_SIDE = 1 << 14
#: Bits decoded at a time on the fast path, and the longest code the encoder makes.
BLOCK_BITS, LIMIT = 1 << 13, 12
EIGHT = np.arange(8)
#: Bits that no literal takes.
NO_LITERAL = 64
BLACK = np.array([0, 0, 0, 255], np.int16)
#: Near places by distance, nearest columns first, right before left: the short distance codes.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Little-endian bit reader."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        b = self.at >> 3
        return int.from_bytes(self.data[b : b + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v


class Writer:
    """Little-endian bit writer over one integer."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths, bit-reversed as they stand in the stream."""
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if not len(used):
        return codes
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used].astype(np.int64)
    # Each code is the sum of the shares of the code space before it.
    code = np.cumsum((1 << 15) >> n) - ((1 << 15) >> n) >> 15 - n
    back = np.zeros(len(n), np.int64)
    for i in range(int(n[-1])):
        back = np.where(i < n, back << 1 | code >> i & 1, back)
    codes[used] = back
    return codes


@functools.lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


class Code:
    """A prefix code as a table over the next bits: symbol and length of each."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:  # a single symbol takes no bits
            self.bits, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0]), np.array([0])
        else:
            if np.sum(2.0 ** -lengths[used]) != 1:
                raise ValueError("incomplete prefix code")
            self.bits = int(lengths.max())
            used = used[np.argsort(lengths[used], kind="stable")]
            # Codes in order fill the space of all bits, highest first; the stream has the lowest first.
            self.symbol = np.repeat(used, 1 << self.bits - lengths[used])[_reversed(self.bits)]
            self.length = lengths[self.symbol]
        self.symbols, self.lengths, self.largest = self.symbol.tolist(), self.length.tolist(), int(self.symbol.max())
        #: For the start of a literal: its length, or NO_LITERAL before a copy or a cache index.
        self.literal = np.where(self.symbol < 256, self.length, NO_LITERAL)

    def read(self, bits: Bits) -> int:
        v = bits.peek(self.bits)
        bits.at += self.lengths[v]
        return self.symbols[v]


@functools.lru_cache(maxsize=64)
def _code_of(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.int64))


@functools.lru_cache(maxsize=1024)
def _simple(size: int, *symbols: int) -> Code:
    lengths = np.zeros(size, np.int64)
    lengths[list(symbols)] = 1
    return _code_of(lengths.tobytes())


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return _simple(size, first, bits.read(8) if two else first)
    lengths, inner = np.zeros(size, np.int64), np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        inner[LENGTH_ORDER[i]] = bits.read(3)
    inner = Code(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    symbols, taken, mask, data, place, whole = inner.symbols, inner.lengths, (1 << inner.bits) - 1, bits.data, bits.at, int.from_bytes
    found: list[int] = []
    before = 8
    while len(found) < size and left:
        left -= 1
        v = whole(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        s, m = symbols[v & mask], taken[v & mask]
        place += m
        if s < 16:
            found.append(s)
            before = s or before
        else:
            v >>= m
            if s == 16:
                found += [before] * (3 + (v & 3))
                place += 2
            elif s == 17:
                found += [0] * (3 + (v & 7))
                place += 3
            else:
                found += [0] * (11 + (v & 127))
                place += 7
    bits.at = place
    lengths[: min(len(found), size)] = found[:size]
    return _code_of(lengths[: max(256, int(np.flatnonzero(lengths)[-1]) + 1)].tobytes() if size > 256 and lengths.any() else lengths.tobytes())


def _extended(bits: Bits, symbol: int) -> int:
    """Value of a length or distance symbol with its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _literals(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """n pixels, all literals under one group of codes (green, red, blue, alpha)."""
    out = np.empty((n, 4), np.uint8)
    raw = np.frombuffer(bits.data, np.uint8)
    done, at = 0, bits.at
    if not any(c.bits for c in codes):
        out[:] = [codes[k].symbols[0] for k in (1, 0, 2, 3)]
        return out
    coded = [c for c in codes if c.bits]
    longest = sum(c.bits for c in coded)
    while done < n:
        first = at >> 3
        part = raw[first : first + (BLOCK_BITS >> 3) + 16].astype(np.int64)
        part = np.concatenate([part, np.zeros(8, np.int64)])
        words = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        window = (words[:, None] >> EIGHT).ravel()  # the next 17 bits or more at every bit
        # Bits taken by a symbol that starts at each bit, for each different code; then the bit after a whole pixel.
        taken = {id(c): c.length[window & ((1 << c.bits) - 1)] for c in coded}
        size = len(window) - longest
        pos = np.arange(size) + taken[id(coded[0])][:size]
        for c in coded[1:]:
            pos += taken[id(c)][pos]
        stop = min(size, BLOCK_BITS)
        follow, p, want, chain = memoryview(pos), at - (first << 3), n - done, []
        add = chain.append
        while p < stop:
            add(p)
            p = follow[p]
        if len(chain) > want:
            p = chain[want]
            del chain[want:]
        if not chain:
            raise ValueError("bit stream too short")
        where = np.array(chain)
        for c, channel in zip(codes, (1, 0, 2, 3), strict=True):
            if c.bits:
                v = window[where] & ((1 << c.bits) - 1)
                out[done : done + len(chain), channel] = c.symbol[v]
                where += c.length[v]
            else:
                out[done : done + len(chain), channel] = c.symbols[0]
        done += len(chain)
        at = (first << 3) + p
    bits.at = at
    return out


def _argb(px: np.ndarray) -> np.ndarray:
    p = px.astype(np.uint32)
    return p[..., 3] << np.uint32(24) | p[..., 0] << np.uint32(16) | p[..., 1] << np.uint32(8) | p[..., 2]


def _codes(bits: Bits, cache_bits: int) -> list[Code]:
    sizes = (256 + N_LENGTH + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCE)
    return [read_code(bits, s) for s in sizes]


#: Heads of streams that were read lately, by their first bits: many small images share one set of codes.
_heads: OrderedDict[tuple[int, int], tuple[int, int, list[Code]]] = OrderedDict()


def _one_group(bits: Bits, cache_bits: int) -> list[Code]:
    start = bits.at
    whole = lambda n: int.from_bytes(bits.data[start >> 3 : (start + n >> 3) + 1], "little") >> (start & 7) & ((1 << n) - 1)
    key = (cache_bits, whole(256))
    if key in _heads:
        n, value, codes = _heads[key]
        if whole(n) == value:
            bits.at = start + n
            return codes
    codes = _codes(bits, cache_bits)
    _heads[key] = bits.at - start, whole(bits.at - start), codes
    while len(_heads) > 512:
        _heads.popitem(last=False)
    return codes


def _extras(first: int, symbol: int) -> tuple[int, int]:
    """Number of extra bits of a length or distance symbol, and the value that they add to."""
    v = symbol - first
    return (0, v + 1) if v < 4 else (v - 2 >> 1, ((2 + (v & 1)) << (v - 2 >> 1)) + 1)


LENGTHS, DISTANCES = [_extras(0, v) for v in range(N_LENGTH)], [_extras(0, v) for v in range(N_DISTANCE)]


def _tokens(bits: Bits, codes: list[Code], n: int, width: int, cache_bits: int) -> np.ndarray:
    """n pixels under one group of codes: literals, back-references and cache indices, which are filled in when all literals stand."""
    out = np.zeros(n, "<u4")
    _filled(out, _chained(bits, codes, out, 0, width), cache_bits)
    return out.view(np.uint8).reshape(n, 4)[:, [2, 1, 0, 3]]


def _chained(bits: Bits, codes: list[Code], out: np.ndarray, done: int, width: int) -> list[tuple[int, int, int]]:
    """Puts the literals from pixel done on to their places in out; returns the copies and cache indices between them, in order:
    first pixel, length, distance or less the index. The end of a literal that would start at each bit of a block is looked up
    at once, and the chain of literals is followed up to the next copy or index."""
    green, red, blue, alpha, distance = codes
    data, at, whole = bits.data + bytes(16), bits.at, int.from_bytes
    raw, end = np.frombuffer(data, np.uint8), len(bits.data) << 3
    masks = [(1 << c.bits) - 1 for c in codes]
    longest = sum(c.bits for c in codes[:4]) + NO_LITERAL
    rest = [c for c in (red, blue, alpha) if c.bits]
    n, begun, literals, events = len(out), done, [np.zeros((0, 4), np.uint8)], []
    if not any(c.bits for c in codes[:4]) and green.largest < 256:  # one colour, which takes no bits
        out[done:] = alpha.symbols[0] << 24 | red.symbols[0] << 16 | green.symbols[0] << 8 | blue.symbols[0]
        return events
    while done < n:
        if at > end:
            raise ValueError("bit stream too short")
        first = at >> 3
        part = np.concatenate([raw[first : first + (BLOCK_BITS + longest >> 3) + 4], np.zeros(longest + 16 >> 3, np.uint8)]).astype(np.int64)
        words = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        window = (words[:, None] >> EIGHT).ravel()  # the next 17 bits or more at every bit
        size = len(window) - longest
        if size <= 0:
            raise ValueError("bit stream too short")
        own = green.literal[window[:size] & masks[0]]
        follow, taken = np.arange(size) + own, {}
        for c in rest:
            if id(c) not in taken:
                taken[id(c)] = c.length[window & ((1 << c.bits) - 1)]
            follow += taken[id(c)][follow]
        follow[own == NO_LITERAL] = 1 << 40
        chain, stop, p = [], min(size, BLOCK_BITS), at - (first << 3)
        add, step, before = chain.append, memoryview(follow), 0
        while True:
            while p < stop:
                add(p)
                p = step[p]
            if len(chain) - before >= n - done:  # all pixels are there; p is the end of the last
                p = step[chain[before + n - done - 1]]
                if p < 1 << 40:
                    del chain[before + n - done :]
                    done = n
                    break
            if p < 1 << 40:  # the block's end
                done += len(chain) - before
                break
            p = chain.pop()
            done += len(chain) - before
            before = len(chain)
            v = whole(data[first + (p >> 3) : first + (p >> 3) + 10], "little") >> (p & 7)
            s, m = green.symbols[v & masks[0]], green.lengths[v & masks[0]]
            p += m
            if s < 256 + N_LENGTH:
                v >>= m
                extra, length = LENGTHS[s - 256]
                length += v & ((1 << extra) - 1)
                v >>= extra
                k = v & masks[4]
                v >>= distance.lengths[k]
                far, d = DISTANCES[distance.symbols[k]]
                d += v & ((1 << far) - 1)
                p += extra + distance.lengths[k] + far
                if d > 120:
                    d -= 120
                else:
                    x, y = NEAR[d - 1]
                    d = max(1, x + y * width)
                if d > done or done + length > n:
                    raise ValueError("back-reference outside of the image")
                events.append((done, length, d))
                done += length
            else:
                events.append((done, 1, 256 + N_LENGTH - s))
                done += 1
            if done >= n:
                break
        where, px = np.array(chain, np.int64), np.empty((len(chain), 4), np.uint8)
        for c, channel in zip((green, red, blue, alpha), (1, 2, 0, 3), strict=True):
            v = window[where] & ((1 << c.bits) - 1)
            px[:, channel] = c.symbol[v]
            where += c.length[v]
        literals.append(px)
        at = (first << 3) + p
    if at > end:
        raise ValueError("bit stream too short")
    bits.at = at
    plain = np.ones(n - begun, bool)
    if events:
        start, length, _ = np.array(events, np.int64).T
        plain[np.repeat(start - begun - np.cumsum(length) + length, length) + np.arange(length.sum())] = False
    out[begun:][plain] = np.concatenate(literals).view("<u4").ravel()
    return events


#: Files that are read a token a step together; fewer are read one by one.
TOGETHER = 48
#: Steps after which it is looked whether a stream has ended too early.
MOST_STEPS = 4096
#: In tables of codes for many files: the length of a code stands above its value, and what is no literal is marked.
ABOVE, MARK = 32, 1 << 40


def _tables(codes: list[Code]) -> list[np.ndarray]:
    """Green, red, blue, alpha and distance: length and value of the code at each number of its bits, the value where the colour stands in a pixel."""
    green, distance = (c.length << ABOVE | c.symbol for c in (codes[0], codes[4]))
    green = np.where(codes[0].symbol < 256, codes[0].length << ABOVE | codes[0].symbol << 8, green | MARK)
    red, blue, alpha = (c.length << ABOVE | c.symbol << k for c, k in zip(codes[1:4], (16, 0, 24), strict=True))
    if not codes[3].bits:  # one alpha throughout goes with blue
        blue, alpha = blue | alpha[0], alpha * 0
    return [green, red, blue, alpha, distance]


def _tokens_together(jobs: list[tuple[Bits, list[Code], int, int, int]]) -> list[np.ndarray]:
    """_tokens for many images, as (bits, codes, n, width, cache_bits): one token of each is read at a step."""
    tables, at_of, offset, size = [], {}, np.zeros((len(jobs), 5), np.int64), 0
    for i, (_, codes, *_) in enumerate(jobs):
        if id(codes) not in at_of:
            at_of[id(codes)] = []
            for t in _tables(codes):
                at_of[id(codes)].append(size)
                tables.append(t)
                size += len(t)
        offset[i] = at_of[id(codes)]
    table = np.concatenate(tables)
    mask = np.array([[(1 << c.bits) - 1 for c in codes] for _, codes, *_ in jobs], np.int64)
    alpha = mask[:, 3].any()
    lengths = np.array([len(b.data) for b, *_ in jobs], np.int64)
    begins = np.cumsum(lengths) - lengths
    data = b"".join([*(b.data for b, *_ in jobs), bytes(8 * MOST_STEPS + 64)])
    at_byte = np.ndarray(len(data) - 8, "<i8", data, strides=(1,))  # eight bytes from each byte on
    sizes = np.array([j[2] for j in jobs], np.int64)
    base = np.cumsum(sizes) - sizes
    flat, found = np.zeros(int(sizes.sum()), "<u4"), []
    job, at, pos, end, last = np.arange(len(jobs)), begins * 8 + [b.at for b, *_ in jobs], base.copy(), base + sizes, (begins + lengths) * 8
    more, plus = np.array(LENGTHS).T, np.array(DISTANCES).T
    near = np.array(NEAR).T
    width = np.array([j[3] for j in jobs], np.int64)
    (go, ro, bo, xo, do), (gm, rm, bm, xm, dm) = offset.T.copy(), mask.T.copy()
    own = [job, at, pos, end, last, width, go, ro, bo, xo, do, gm, rm, bm, xm, dm]
    while len(own[0]) >= TOGETHER:
        job, at, pos, end, last, width, go, ro, bo, xo, do, gm, rm, bm, xm, dm = own
        for _ in range(min(MOST_STEPS, int((end - pos).min()))):
            v = at_byte[at >> 3] >> (at & 7)
            e = table[(v & gm) + go]
            whole = e
            for o, m in ((ro, rm), (bo, bm), (xo, xm)) if alpha else ((ro, rm), (bo, bm)):
                v >>= e >> ABOVE
                e = table[(v & m) + o]
                whole = whole + e
            flat[pos] = whole & 0xFFFFFFFF
            other = np.flatnonzero(whole >= MARK)
            if not len(other):
                at += whole >> ABOVE
                pos += 1
                continue
            e = table[(at_byte[at[other] >> 3] >> (at[other] & 7) & gm[other]) + go[other]]
            whole[other] = 0
            at += whole >> ABOVE
            at[other] += (e ^ MARK) >> ABOVE
            symbol, m, d = e & 0xFFFFFFFF, np.ones(len(other), np.int64), 256 + N_LENGTH - (e & 0xFFFFFFFF)
            copies = np.flatnonzero(symbol < 256 + N_LENGTH)
            if len(copies):
                which = other[copies]
                extra, least = more[:, symbol[copies] - 256]
                p = at[which]
                m[copies] = least + (at_byte[p >> 3] >> (p & 7) & ((1 << extra) - 1))
                p += extra
                v = at_byte[p >> 3] >> (p & 7)
                e = table[(v & dm[which]) + do[which]]
                extra, least = plus[:, e & 0xFFFFFFFF]
                p += e >> ABOVE
                far = least + (at_byte[p >> 3] >> (p & 7) & ((1 << extra) - 1))
                at[which] = p + extra
                x, y = near[:, np.minimum(far, 120) - 1]
                d[copies] = np.where(far > 120, far - 120, np.maximum(1, x + y * width[which]))
                begun = pos[which] - base[job[which]]
                if (d[copies] > begun).any() or (pos[which] + m[copies] > end[which]).any():
                    raise ValueError("back-reference outside of the image")
            found.append(np.stack([job[other], pos[other] - base[job[other]], m, d]))
            pos += 1
            pos[other] += m - 1
            if len(copies):
                break
        if (at > last).any():
            raise ValueError("bit stream too short")
        if (pos >= end).any():
            own = [x[pos < end] for x in own]
    events = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    events = events[:, np.argsort(events[0], kind="stable")]
    cuts = np.searchsorted(events[0], np.arange(len(jobs) + 1)).tolist()
    of = list(zip(*events[1:].tolist(), strict=True))
    left = {j: (a, p) for j, a, p in zip(*(x.tolist() for x in own[:3]), strict=True)}
    images = []
    for i, (bits, codes, n, w, cache_bits) in enumerate(jobs):
        out, mine = flat[base[i] : base[i] + n], of[cuts[i] : cuts[i + 1]]
        if i in left:
            bits.at = left[i][0] - int(begins[i]) * 8
            mine += _chained(bits, codes, out, left[i][1] - int(base[i]), w)
        _filled(out, mine, cache_bits)
        images.append(out.view(np.uint8).reshape(n, 4)[:, [2, 1, 0, 3]])
    return images


def _filled(out: np.ndarray, events: list[tuple[int, int, int]], cache_bits: int) -> None:
    """Fills in copies and cache indices. What an index stands for is the last pixel before it in its slot of the cache."""
    if not events:
        return
    px, cached = memoryview(out), any(e[2] <= 0 for e in events)
    if cached:
        slot = (out * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        slots, numbers = bytearray(slot.astype(np.uint8).tobytes()), slot.tolist() if cache_bits > 8 else None
    for at, m, d in events:
        if d > 0:
            upto = at + m
            for i in range(at, upto, d):
                j = min(i + d, upto)
                px[i:j] = px[i - d : j - d]
                if cached:
                    slots[i:j] = slots[i - d : j - d]
                    if numbers:
                        numbers[i:j] = numbers[i - d : j - d]
            continue
        k = slots.rfind(-d & 255, 0, at)
        while numbers and k >= 0 and numbers[k] != -d:
            k = slots.rfind(-d & 255, 0, k)
        # An empty slot holds 0, whose own slot is 0.
        px[at] = px[k] if k >= 0 else 0
        slots[at] = slots[k] if k >= 0 else 0
        if numbers:
            numbers[at] = numbers[k] if k >= 0 else 0


def _previous(keys: np.ndarray) -> np.ndarray:
    """The last place before each with the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def read_image(bits: Bits, width: int, height: int, main: bool, wait: bool = False) -> np.ndarray | tuple:
    """An entropy-coded image as an array (height, width, 4); if it may wait, only what _tokens_together takes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, group_bits = None, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        meta = read_image(bits, (width + (1 << group_bits) - 1) >> group_bits, (height + (1 << group_bits) - 1) >> group_bits, False)
        groups_of = meta[..., 0].astype(int) << 8 | meta[..., 1]
    n = width * height
    groups = [_codes(bits, cache_bits) for _ in range(int(groups_of.max()) + 1)] if groups_of is not None else [_one_group(bits, cache_bits) if main else _codes(bits, cache_bits)]
    if wait and groups_of is None and sum(c.bits for c in groups[0][:4]) <= 57:
        return bits, groups[0], n, width, cache_bits
    if groups_of is None and not cache_bits and groups[0][0].largest < 256:
        return _literals(bits, groups[0][:4], n).reshape(height, width, 4)
    if groups_of is None:
        return _tokens(bits, groups[0], n, width, cache_bits).reshape(height, width, 4)
    out = np.zeros((n, 4), np.uint8)
    cache, cached = np.zeros((1 << cache_bits, 4), np.uint8), 0

    def fill(upto: int) -> None:
        """Bring the colour cache up to date; of equal places the last pixel stays."""
        nonlocal cached
        new = out[cached:upto]
        cache[(_argb(new) * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)] = new
        cached = upto

    i = 0
    while i < n:
        g = groups[groups_of[i // width >> group_bits, i % width >> group_bits]] if groups_of is not None else groups[0]
        s = g[0].read(bits)
        if s < 256:
            r, b, a = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            out[i] = r, s, b, a
            i += 1
        elif s < 256 + N_LENGTH:
            length = _extended(bits, s - 256)
            d = _extended(bits, g[4].read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i or i + length > n:
                raise ValueError("back-reference outside of the image")
            while length:
                m = min(length, d)
                out[i : i + m] = out[i - d : i - d + m]
                i, length = i + m, length - m
                # What was just copied may be copied on, from the same distance.
        else:
            fill(i)
            out[i] = cache[s - 256 - N_LENGTH]
            i += 1
    return out.reshape(height, width, 4)


# -- inverse transforms


def _blocks(sub: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(sub, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def _avg(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _guess(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The prediction of a mode from four neighbours, for arrays of pixels (16-bit, colours last)."""
    if mode == 0:
        return np.broadcast_to(BLACK, left.shape)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode <= 10:
        return (
            lambda: _avg(_avg(left, right), top), lambda: _avg(left, corner), lambda: _avg(left, top),
            lambda: _avg(corner, top), lambda: _avg(top, right), lambda: _avg(_avg(left, corner), _avg(top, right)),
        )[mode - 5]()
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    half = _avg(left, top)
    away = half - corner
    return np.clip(half + (away + (away < 0) >> 1), 0, 255)  # halved towards zero


def _differences(modes: np.ndarray, px: np.ndarray) -> np.ndarray:
    """px less its predictions; modes per pixel. Every neighbour is known, so the whole image is one step for each mode."""
    h, w = modes.shape
    src = px.astype(np.int16)
    out = src.copy()
    out[0, 0] -= BLACK
    out[0, 1:] -= src[0, :-1]
    out[1:, 0] -= src[:-1, 0]
    if h > 1 and w > 1:
        # Right above the last pixel of a row stands the first of that row.
        right = np.concatenate([src[:-1, 2:], src[1:, :1]], 1)
        around, own = (src[1:, :-1], src[:-1, 1:], src[:-1, :-1], right), modes[1:, 1:]
        for m in np.flatnonzero(np.bincount(own.ravel())).tolist():
            here = own == m
            if here.all():
                out[1:, 1:] -= _guess(m, *around)
            else:
                out[1:, 1:][here] -= _guess(m, *(x[here] for x in around))
    return out.astype(np.uint8)


def _steps(mode: int, left: list[int], top: list[list[int]], corner: list[list[int]], right: list[list[int]], delta: list[list[int]]) -> list[list[int]]:
    """Pixels of a part of a row whose mode looks at the pixel before, each list for one colour, one pixel after another."""
    if mode == 11:
        out = [[] for _ in delta]
        for d, t, c in zip(zip(*delta), zip(*top), zip(*corner)):
            to_left = to_top = 0
            for x, y, z in zip(left, t, c):
                to_left += abs(y - z)
                to_top += abs(x - z)
            left = [(x + y) & 255 for x, y in zip(d, left if to_left < to_top else t)]
            for o, x in zip(out, left):
                o.append(x)
        return out
    out = []
    for v, ts, cs, rs, ds in zip(left, top, corner, right, delta):
        row = []
        add = row.append
        if mode == 1:
            for d in ds:
                v = (v + d) & 255
                add(v)
        elif mode == 5:
            for d, t, r in zip(ds, ts, rs):
                v = ((((v + r) >> 1) + t >> 1) + d) & 255
                add(v)
        elif mode == 6:
            for d, c in zip(ds, cs):
                v = ((v + c >> 1) + d) & 255
                add(v)
        elif mode == 7:
            for d, t in zip(ds, ts):
                v = ((v + t >> 1) + d) & 255
                add(v)
        elif mode == 10:
            for d, t, c, r in zip(ds, ts, cs, rs):
                v = (((v + c >> 1) + (t + r >> 1) >> 1) + d) & 255
                add(v)
        elif mode == 12:
            for d, t, c in zip(ds, ts, cs):
                v += t - c
                v = ((0 if v < 0 else 255 if v > 255 else v) + d) & 255
                add(v)
        else:
            for d, t, c in zip(ds, ts, cs):
                v = v + t >> 1
                away = v - c
                v += away >> 1 if away >= 0 else -(-away >> 1)
                v = ((0 if v < 0 else 255 if v > 255 else v) + d) & 255
                add(v)
        out.append(row)
    return out


def _summed(modes: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The image whose differences from its predictions are delta. Modes that look only at the row above take a row at once."""
    h, w = modes.shape
    out = delta.copy()
    out[0, 0] += BLACK.astype(np.uint8)
    out[0] = np.cumsum(out[0], 0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], 0, dtype=np.uint8)
    if h == 1 or w == 1:
        return out
    first = int(modes[1, 1])
    if first <= 2 and (modes[1:, 1:] == first).all():
        if first == 0:
            out[1:, 1:] += BLACK.astype(np.uint8)
        elif first == 1:
            out[1:] = np.cumsum(out[1:], 1, dtype=np.uint8)
        else:
            out[:, 1:] = np.cumsum(out[:, 1:], 0, dtype=np.uint8)
        return out
    colours = slice(None) if delta[..., 3].any() else slice(3)  # without differences, alpha is 255 under every mode
    if colours.stop:
        out[..., 3] = 255
    ends = np.diff(modes[:, 1:].astype(np.int16), axis=1) != 0
    for y in range(1, h):
        cuts = [1, *(np.flatnonzero(ends[y]) + 2).tolist(), w]
        for i, j in zip(cuts, cuts[1:]):
            mode, top, corner = int(modes[y, i]), out[y - 1, i:j, colours].astype(np.int16), out[y - 1, i - 1 : j - 1, colours].astype(np.int16)
            right = np.concatenate([out[y - 1, i + 1 : j + 1, colours], out[y, :1, colours][: j == w]]).astype(np.int16)
            if mode in (0, 2, 3, 4, 8, 9):
                out[y, i:j, colours] += (_guess(mode, top, top, corner, right) if mode else BLACK[colours]).astype(np.uint8)
            else:
                part = _steps(mode, out[y, i - 1, colours].tolist(), top.T.tolist(), corner.T.tolist(), right.T.tolist(), delta[y, i:j, colours].T.tolist())
                out[y, i:j, colours] = np.array(part, np.uint8).T
    return out


def _cross(sub: np.ndarray, px: np.ndarray, inverse: bool) -> np.ndarray:
    """sub: red-to-blue, green-to-blue and green-to-red of each pixel in its three colours, signed."""
    t = sub.astype(np.int8).astype(np.int16)
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int16)
    out, sign = px.astype(np.int16), 1 if inverse else -1
    green = signed(out[..., 1])
    red = out[..., 0] + sign * ((t[..., 2] * green) >> 5)
    by = signed(red & 255) if inverse else signed(out[..., 0])
    out[..., 2] += sign * ((t[..., 1] * green) >> 5) + sign * ((t[..., 0] * by) >> 5)
    out[..., 0] = red
    return (out & 255).astype(np.uint8)


def _opened(data: bytes, wait: bool = False) -> tuple[np.ndarray | tuple, list[tuple], bool]:
    """Stored pixels of a file (if they may wait, see read_image), the transforms to undo (kind, size, width, sub-image; the last
    first), and if alpha is 255 throughout."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    bits.at = 8
    full, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    bits.read(3)
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            size = bits.read(3) + 2
            side = lambda n, size=size: (n + (1 << size) - 1) >> size
            undo.append((kind, size, width, read_image(bits, side(width), side(height), False)))
        elif kind == 2:
            undo.append((2, 0, width, None))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(read_image(bits, n, 1, False)[0].astype(int), 0).astype(np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((3, pack, width, table))
            width = (width + (1 << pack) - 1) >> pack
    return read_image(bits, width, height, True, wait), undo[::-1], opaque


def _undone(px: np.ndarray, kind: int, size: int, width: int, sub: np.ndarray | None) -> np.ndarray:
    height = len(px)
    if kind == 0:
        return _summed(_blocks(sub[..., 1], size, height, width), px)
    if kind == 1:
        alike = (sub == sub[:1, :1]).all()
        return _cross(sub[0, 0] if alike else _blocks(sub, size, height, width), px, True)
    if kind == 2:
        px = px.copy()
        px[..., 0] += px[..., 1]
        px[..., 2] += px[..., 1]
        return px
    depth = 8 >> size
    index = px[..., 1, None] >> (np.arange(1 << size) * depth).astype(np.uint8) & ((1 << depth) - 1)
    index = index.reshape(height, -1)[:, :width]
    return np.vstack([sub, np.zeros((max(0, 256 - len(sub)), 4), np.uint8)])[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    px, undo, opaque = _opened(data)
    for step in undo:
        px = _undone(px, *step)
    if opaque:
        px[..., 3] = 255
    return px


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file. Tokens of all files are read together, and images that are predicted by one mode throughout are
    summed up together, mode by mode."""
    opened = [_opened(f, True) for f in files]
    images, undo = [o[0] for o in opened], [o[1] for o in opened]
    waiting = [i for i, x in enumerate(images) if isinstance(x, tuple)]
    for i, px in zip(waiting, _tokens_together([images[i] for i in waiting]) if waiting else [], strict=True):
        images[i] = px.reshape(-1, images[i][3], 4)
    while any(undo):
        alike: dict[tuple[int, int], list[int]] = {}
        for i, steps in enumerate(undo):
            while steps:
                kind, _, width, sub = steps[0]
                if kind == 0 and min(images[i].shape[:2]) > 1 and (sub[..., 1] == sub[0, 0, 1]).all():
                    alike.setdefault((int(sub[0, 0, 1]), width), []).append(i)
                    break
                images[i] = _undone(images[i], *steps.pop(0))
        for (mode, _), group in alike.items():
            for i, px in zip(group, _summed_together(mode, [images[i] for i in group]), strict=True):
                images[i] = px
                undo[i].pop(0)
    for px, (_, _, opaque) in zip(images, opened, strict=True):
        if opaque:
            px[..., 3] = 255
    return images


def _summed_together(mode: int, deltas: list[np.ndarray]) -> list[np.ndarray]:
    """_summed for images of one width and one mode. A pixel's four neighbours all stand two steps earlier in the row above or
    one in its own, if each row starts two steps after the one above: so many rows of all images take a step at once."""
    if mode <= 2:
        return [_summed(np.full(d.shape[:2], mode, np.uint8), d) for d in deltas]
    out, w = np.ascontiguousarray(np.concatenate(deltas)), deltas[0].shape[1]
    heights = np.array([len(d) for d in deltas])
    top = np.cumsum(heights) - heights
    out[top, 0] += BLACK.astype(np.uint8)
    out[top] = np.cumsum(out[top], 1, dtype=np.uint8)
    for i, h in zip(top.tolist(), heights.tolist(), strict=True):
        out[i : i + h, 0] = np.cumsum(out[i : i + h, 0], 0, dtype=np.uint8)
    flat = out.view("<u4").ravel()
    y = np.arange(len(out)) - np.repeat(top, heights)  # row within its image
    order = np.argsort(y, kind="stable")[len(deltas) :]
    y, start = y[order], order * w - 2 * y[order]  # at step t, a row is at pixel start + t
    steps = np.arange(2 * int(heights.max()) + w)
    begin, end = np.searchsorted(y, -((w - 1 - steps) // 2), "left").tolist(), np.searchsorted(y, (steps - 1) // 2, "right").tolist()
    spread = lambda at: flat[at].view(np.uint8).reshape(-1, 4).astype(np.int16)
    for t, i, j in zip(steps.tolist(), begin, end, strict=True):
        if i < j:
            at = start[i:j] + t
            guess = _guess(mode, *(spread(at - k) for k in (1, w, w + 1, w - 1)))
            flat[at] = (spread(at) + guess).astype(np.uint8).view("<u4").ravel()
    return np.split(out, top[1:])


# -- encoder


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a complete prefix code: by the information of each symbol, then shortened from the most frequent on until complete."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(-counts[used], kind="stable")]
    n = np.clip(np.ceil(np.log2(counts.sum() / counts[order])), 1, limit).astype(int).tolist()
    room = (1 << limit) - sum(1 << (limit - x) for x in n)
    at = len(n) - 1
    while room < 0:  # rare symbols at the limit took too much: lengthen from the rarest of the others on
        if n[at] < limit:
            room += 1 << (limit - n[at] - 1)
            n[at] += 1
        else:
            at -= 1
    while room:
        for i, x in enumerate(n):
            if x > 1 and 1 << (limit - x) <= room:
                room -= 1 << (limit - x)
                n[i] = x - 1
    lengths[order] = n
    return lengths


def shortest_lengths(shares: np.ndarray) -> np.ndarray:
    """Lengths of the shortest prefix code (Huffman's), if none is beyond LIMIT, else those of code_lengths."""
    least = shares.sum() / 3000  # keeps codes short
    heap = [(max(v, least), i, [i]) for i, v in enumerate(shares.tolist()) if v]
    heapq.heapify(heap)
    lengths = np.zeros(len(shares), np.int64)
    while len(heap) > 1:
        (v, i, a), (u, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        lengths[a + b] += 1
        heapq.heappush(heap, (v + u, i, a + b))
    return lengths if 0 < lengths.max() <= LIMIT else code_lengths(shares)


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        out.put(0b101, 3)  # simple, one symbol, of 8 bits
        out.put(int(used[0]) if len(used) else 0, 8)
        return
    runs = []
    starts = np.concatenate([[0], np.flatnonzero(lengths[1:] != lengths[:-1]) + 1])
    for v, m in zip(lengths[starts].tolist(), np.diff(starts, append=len(lengths)).tolist(), strict=True):
        if v:
            runs.append((v, 0, 0))
            m -= 1
        while m >= 3 and v:
            k = min(m, 6)
            runs.append((16, k - 3, 2))
            m -= k
        while m >= 11 and not v:
            k = min(m, 138)
            runs.append((18, k - 11, 7))
            m -= k
        if m >= 3 and not v:
            runs.append((17, m - 3, 3))
            m = 0
        runs += [(v, 0, 0)] * m
    inner = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    codes = canonical(inner)
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(int(inner[s]), 3)
    out.put(0, 1)
    taken = (inner * (np.count_nonzero(inner) > 1)).tolist()
    codes = (codes * (inner > 0)).tolist() if any(taken) else [0] * len(taken)
    value, size = 0, 0
    for s, extra, n_extra in runs:
        value |= (codes[s] | extra << taken[s]) << size
        size += taken[s] + n_extra
    out.put(value, size)


def _pack(values: np.ndarray, sizes: np.ndarray, head: Writer) -> bytes:
    """The head, then each value in so many bits."""
    ends = np.cumsum(sizes.astype(np.int64)) + head.n
    starts = ends - sizes
    word, shift = starts >> 6, (starts & 63).astype(np.uint64)
    n = int(ends[-1] if len(ends) else head.n)
    words = np.zeros((n >> 6) + 2, np.uint64)
    if len(values):
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((starts & 63) + sizes > 64)  # one value at most reaches into the next word
        words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    body = words.view(np.uint8)
    top = np.frombuffer(head.value.to_bytes(head.n // 8 + 1, "little"), np.uint8)
    body[: len(top)] |= top
    return body[: (n + 7) >> 3].tobytes()


def _typical() -> np.ndarray:
    """Weights of bytes in plain prose (parameters of the code that small images share)."""
    w = np.ones(256)
    w[160:192] = 8
    w[[0xC2, 0xC3]] = 12, 60
    w[48:58], w[65:91] = 12, 12
    w[97:123] = [1200 / (3 + "etainorshdlucmfgpwbvykzjqx".index(chr(c))) for c in range(97, 123)]
    w[[32, 10]] = 900, 40
    for c in ".,|":
        w[ord(c)] = 60
    return w


@functools.lru_cache(maxsize=1)
def _shared_code() -> tuple[np.ndarray, np.ndarray]:
    n = code_lengths(_typical())
    return n, canonical(n)


def _image(head: Writer, px: np.ndarray, main: bool, colour: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Writes the head of an image of literals; returns what follows it as values and sizes. colour: lengths of the one code
    that green, red and blue share, else each gets its own."""
    head.put(0, 2 if main else 1)
    values, sizes = np.zeros(len(px), np.uint64), np.zeros(len(px), np.int64)
    common = None
    for k, channel in enumerate((1, 0, 2, 3)):
        c = px[:, channel]
        n = np.zeros(256 + N_LENGTH if k == 0 else 256, np.int64)
        n[:256] = code_lengths(np.bincount(c, minlength=256)) if k == 3 or colour is None else colour
        if k == 3 or colour is None:
            codes = canonical(n)
            write_code(head, n)
        elif common is None or k == 1:  # green's alphabet is longer, so red's head differs
            codes = canonical(n)
            before = head.n
            write_code(head, n)
            common = (head.value >> before, head.n - before)
        else:
            head.put(*common)
        if np.count_nonzero(n) > 1:
            values |= codes.astype(np.uint64)[c] << sizes.astype(np.uint64)
            sizes += n[c]
    write_code(head, np.zeros(N_DISTANCE, np.int64))
    return values, sizes


@functools.lru_cache(maxsize=1)
def _shared_head() -> tuple[int, int]:
    """The head of an opaque image without transforms under the shared code, from the bit after the size fields."""
    w = Writer()
    w.put(0, 1)
    _image(w, np.full((1, 4), 255, np.uint8), True, _shared_code()[0])
    return w.value, w.n


#: Pixels below which an image takes the shared code instead of its own.
OWN_CODE = 2048


def _file(stream: bytes) -> bytes:
    size = len(stream)
    return b"RIFF" + struct.pack("<I", 12 + size + (size & 1)) + b"WEBPVP8L" + struct.pack("<I", size) + stream + b"\0" * (size & 1)


def _start(width: int, height: int) -> Writer:
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    return w


def _colours(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., 0].astype(np.uint32) << np.uint32(16) | rgb[..., 1].astype(np.uint32) << np.uint32(8) | rgb[..., 2]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def palette(rgb: np.ndarray) -> np.ndarray | None:
    """The colours of an image, sorted, if they are few enough to be worth a palette."""
    colours = _colours(rgb).ravel()
    few = _distinct(colours[:1024])
    if len(colours) > 1024 and len(few) <= 256:
        few = _distinct(colours)
    return few if len(few) <= 256 and len(few) * 4 <= len(colours) else None


def encode(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of an image (height, width, 3). Few colours go to a palette; small images share one prefix code."""
    height, width, _ = rgb.shape
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    few = palette(rgb)
    if few is not None:
        return encode_palette(rgb, few)
    w = _start(width, height)
    if n < OWN_CODE:
        head, size = _shared_head()
        w.put(head, size)
        lengths, codes = _shared_code()
        c = codes.astype(np.uint64)
        values, sizes = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for k in (1, 0, 2):
            values |= c[flat[:, k]] << sizes.astype(np.uint64)
            sizes += lengths[flat[:, k]]
        return _file(_pack(values, sizes, w))
    w.put(0, 1)
    px = np.concatenate([flat, np.full((n, 1), 255, np.uint8)], 1)
    values, sizes = _image(w, px, True, code_lengths(np.bincount(flat.ravel(), minlength=256)))
    return _file(_pack(values, sizes, w))


def _sub_image(w: Writer, px: np.ndarray) -> Writer:
    """Appends a small image of literals."""
    if (px == px[0]).all():  # five codes of one symbol each, and no bits for the pixels
        w.put(0, 1)
        for v in (*px[0, [1, 0, 2, 3]].tolist(), 0):
            w.put(0b101 | v << 3, 11)
        return w
    values, sizes = _image(w, px, False)
    for v, n in zip(values.tolist(), sizes.tolist(), strict=True):
        w.put(v, n)
    return w


def encode_palette(rgb: np.ndarray, few: np.ndarray) -> bytes:
    """A file whose pixels are indices into the given sorted colours, several to a stored pixel where they are 16 or fewer."""
    colours = _colours(rgb)
    height, width = colours.shape
    w = _start(width, height)
    w.put(0b111, 3)  # a transform follows: colour indexing
    w.put(len(few) - 1, 8)
    table = np.stack([few >> 16 & 255, few >> 8 & 255, few & 255, np.full(len(few), 255)], 1).astype(np.uint8)
    _sub_image(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)))
    pack = 3 if len(few) <= 2 else 2 if len(few) <= 4 else 1 if len(few) <= 16 else 0
    per, depth = 1 << pack, 8 >> pack
    index = np.searchsorted(few, colours)
    index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
    green = (index << np.arange(per) * depth).sum(2).astype(np.uint8).ravel()
    px = np.zeros((len(green), 4), np.uint8)
    px[:, 1], px[:, 3] = green, 255
    w.put(0, 1)
    return _file(_written(w, px, width + per - 1 >> pack, 4))


def _cheapest(px: np.ndarray, ways: tuple[tuple[int, int, int], ...]) -> tuple[tuple[int, int, int], np.ndarray]:
    """The cross-colour factors under which red and blue take the fewest bits, by the information of their values, and what they give."""
    found, most = None, -1
    for way in ways:
        out = _cross(np.array(way), px, False)
        n = np.concatenate([np.bincount(out[..., k].ravel(), minlength=256) for k in (0, 2)])
        spared = int((n * np.log2(np.maximum(n, 1))).sum())
        if spared > most:
            found, most = (way, out), spared
    return found


def encode_thorough(rgb: np.ndarray, modes: np.ndarray | None = None, cross: tuple[int, int, int] | tuple[tuple[int, int, int], ...] | None = None, subtract_green: bool = False, cache_bits: int = 4, block_bits: int = 2) -> bytes:
    """Like encode, with the tools asked for: predictor modes (one per block), cross-colour factors, subtract green, a colour
    cache, and back-references to the nearest equal run. Of several cross-colour factors the cheapest are taken. Small predicted
    images of one mode share their prefix codes."""
    height, width, _ = rgb.shape
    px = np.concatenate([rgb, np.full((height, width, 1), 255, np.uint8)], 2)
    w = _start(width, height)
    sides = (height + (1 << block_bits) - 1) >> block_bits, (width + (1 << block_bits) - 1) >> block_bits
    if subtract_green:
        w.put(0b101, 3)
        px[..., 0] -= px[..., 1]
        px[..., 2] -= px[..., 1]
    if modes is not None:
        sub = np.zeros((*sides, 4), np.uint8)
        sub[..., 1], sub[..., 3] = modes, 255
        w.put(0b001, 3)
        w.put(block_bits - 2, 3)
        _sub_image(w, sub.reshape(-1, 4))
        px = _differences(_blocks(sub[..., 1], block_bits, height, width), px)
    if cross is not None:
        cross, px = _cheapest(px, cross) if isinstance(cross[0], tuple) else (cross, _cross(np.array(cross), px, False))
        sub = np.zeros((*sides, 4), np.uint8)
        sub[...] = [*(c & 255 for c in cross), 255]
        w.put(0b011, 3)
        w.put(block_bits - 2, 3)
        _sub_image(w, sub.reshape(-1, 4))
    w.put(0, 1)
    return _file(_written(w, px.reshape(-1, 4), width, cache_bits, modes if isinstance(modes, int) else None))


#: Longest copy and farthest source that the format can tell.
MAX_COPY, MAX_FAR = 4096, (1 << 20) - 120


def _copies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of the runs that are copied: each place looks at the last one before with the same three
    pixels, neighbours with one distance are one run, and runs are taken greedily from the left."""
    k = keys.astype(np.uint64)
    before = np.zeros(0, np.int64)
    if len(k) > 2:
        three = k[:-2] * np.uint64(0x9E3779B97F4A7C15) + k[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + k[2:] * np.uint64(0x165667B19E3779F9)
        before = _previous((three >> np.uint64(48)).astype(np.uint16) if len(k) < OWN_CODE else three)  # short keys sort faster
    far = np.where(before >= 0, np.arange(len(before)) - before, 0)
    for j in range(3):  # hashes may be equal by chance
        far[keys[np.arange(len(far)) + j] != keys[np.arange(len(far)) - far + j]] = 0
    far[far > MAX_FAR] = 0
    cuts = np.flatnonzero(np.diff(far, prepend=0, append=0))
    out, at = [], 0
    for i, j, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), far[cuts[:-1]].tolist()):
        i = max(i, at)
        if d and i < j:
            at = j + 2
            out += [(x, min(MAX_COPY, at - x), d) for x in range(i, at, MAX_COPY)]
    start, length, d = np.array(out, np.int64).reshape(-1, 3).T
    return start, length, d


def _symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and extra bits of lengths or distances."""
    v = values - 1
    extra = np.maximum(np.frexp(v)[1].astype(np.int64) - 2, 0)
    return np.where(v < 4, v, 2 * extra + 2 + (v >> extra & 1)), np.where(v < 4, 0, extra), np.where(v < 4, 0, v & ((1 << extra) - 1))


@functools.lru_cache(maxsize=16)
def _near_codes(width: int) -> np.ndarray:
    """The short code of each distance that has one, else 0."""
    out = np.zeros(8 * width + 16, np.int64)
    for k, (x, y) in reversed(list(enumerate(NEAR))):
        out[max(1, x + y * width)] = k + 1
    return out


#: Differences within prose are shared out in bands by their size, so that the codes' own lengths take few bits.
BANDS = (0, 1, 3, 6, 9, 12, 15, 18, 22, 26, 32, 40, 48, 56, 64, 72, 80, 88, 96, 108, 129)


def _prose(rows: int, width: int) -> np.ndarray:
    """An image of bytes drawn as in plain prose."""
    i = np.arange(rows * width * 3, dtype=np.uint64)
    i = (i ^ i >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    i = (i ^ i >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    share = (i >> np.uint64(40)).astype(float) / (1 << 24)
    total = np.cumsum(_typical())
    return np.searchsorted(total, share * total[-1], "right").astype(np.uint8).reshape(rows, width, 3)


@functools.lru_cache(maxsize=64)
def _shared_codes(cache_bits: int, mode: int) -> tuple[list[np.ndarray], list[np.ndarray], int, int]:
    """Code lengths, codes and head for plain prose predicted by a mode (parameters that small predicted images share)."""
    if mode:
        px = np.concatenate([_prose(256, 64), np.full((256, 64, 1), 255, np.uint8)], 2)
        apart = np.bincount(_differences(np.full((256, 64), mode, np.uint8), px)[1:, 1:, :3].ravel(), minlength=256)
        k = np.arange(256)
        band = np.where(k < 128, 0, len(BANDS)) + np.searchsorted(BANDS, np.minimum(k, 256 - k), "right")
        p = (np.bincount(band, apart) / np.maximum(np.bincount(band), 1))[band] / apart.sum() + 1 / 8192
    else:
        p = _typical() / _typical().sum()
    green = np.concatenate([p, np.repeat(0.005 * 0.5 ** np.arange(6), 4), np.full(1 << cache_bits if cache_bits else 0, 0.02 / (1 << cache_bits))])
    whole = np.zeros(256, np.int64)
    whole[0] = 1
    lengths = [shortest_lengths(green), shortest_lengths(p), shortest_lengths(p), whole, code_lengths(np.ones(N_DISTANCE))]
    w = Writer()
    for n in lengths:
        write_code(w, n)
    return lengths, [canonical(n) for n in lengths], w.value, w.n


def _written(w: Writer, px: np.ndarray, width: int, cache_bits: int, mode: int | None = None) -> bytes:
    """The stream of an image: the head, then literals, cache indices and back-references to equal runs. mode: the one mode by
    which a small image is predicted, for its shared codes; without it, and for large ones, codes are its own."""
    keys = _argb(px)
    start, length, d = _copies(keys)
    covered = np.zeros(len(keys) + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + length, -1)
    alone = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    slot = np.zeros(len(keys), np.int64)
    cached = np.zeros(len(keys), bool)
    if cache_bits:
        slot = ((keys * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        before = _previous(slot.astype(np.uint16))
        cached = (before >= 0) & (keys[before] == keys)
    hits, plain = alone[cached[alone]], alone[~cached[alone]]
    g, r, b, a = (px[plain, k].astype(np.int64) for k in (1, 0, 2, 3))
    near = _near_codes(width)
    short = near[np.minimum(d, len(near) - 1)] * (d < len(near))
    long_s, long_n, long_x = _symbols(length)
    far_s, far_n, far_x = _symbols(np.where(short > 0, short, d + 120))
    greens = (g, 256 + long_s, 256 + N_LENGTH + slot[hits])
    if mode is not None and len(keys) < OWN_CODE and not a.any():
        lengths, codes, head, n_head = _shared_codes(cache_bits, mode)
    else:
        size = 256 + N_LENGTH + (1 << cache_bits if cache_bits else 0)
        counts = (np.bincount(np.concatenate(greens), minlength=size), np.bincount(r, minlength=256) + np.bincount(b, minlength=256), np.bincount(a, minlength=256), np.bincount(far_s, minlength=N_DISTANCE))
        green, both, alpha, distance = (code_lengths(n) for n in counts)
        lengths = [green, both, both, alpha, distance]  # red and blue share a code
        codes, own = [canonical(green), both := canonical(both), both, canonical(alpha), canonical(distance)], Writer()
        for n in lengths:
            write_code(own, n)
        head, n_head = own.value, own.n
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    w.put(0, 1)
    w.put(head, n_head)
    taken = [n * (np.count_nonzero(n) > 1) for n in lengths]
    codes = [(c * (n > 0)).astype(np.uint64) for c, n in zip(codes, taken, strict=True)]

    def joined(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, size = np.zeros(len(parts[0][0]), np.uint64), np.zeros(len(parts[0][0]), np.int64)
        for v, n in parts:
            value |= v.astype(np.uint64) << size.astype(np.uint64)
            size = size + n
        return value, size

    coded = lambda k, symbols: (codes[k][symbols], taken[k][symbols])
    literal = joined(coded(0, greens[0]), *(coded(k, c) for k, c in ((1, r), (2, b), (3, a)) if taken[k].any()))
    copy = joined(coded(0, greens[1]), (long_x, long_n), coded(4, far_s), (far_x, far_n))
    order = np.argsort(np.concatenate([plain, start, hits]), kind="stable")
    value, size = (np.concatenate(x)[order] for x in zip(literal, copy, coded(0, greens[2])))
    return _pack(value, size, w)
