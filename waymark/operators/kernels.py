"""Kernels over the sorted points of one object at a time: a stream of Arrow batches in, rows of the same columns out.

Spark partitions and sorts by object; a task reads its batches in turn and hands one object's points, as arrays of numbers,
to the kernel. Searches for the first far point go over boxes of blocks of points, for all points of the object at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .naming import fresh

EARTH_M = 6371008.7714


@dataclass
class Group:
    """One object's points in order: times in microseconds, coordinates in degrees."""

    micros: np.ndarray
    lat: np.ndarray
    lng: np.ndarray


def metres(lat1, lng1, lat2, lng2) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return np.where((lat1 == lat2) & (lng1 == lng2), 0.0, 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a)))


def off_line(lat1, lng1, lat2, lng2, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Metres of points to their feet on the line through two places; to the first one where both are the same."""

    def way(y, x):
        p, q, d = np.radians(lat1), np.radians(y), np.radians(x - lng1)
        return np.arctan2(np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d))

    length = metres(lat1, lng1, lat2, lng2)
    rate = metres(lat1, lng1, lat, lng) * np.cos(way(lat, lng) - way(lat2, lng2)) / length if length > 0 else np.zeros(len(lat))
    return metres(lat, lng, lat1 + rate * (lat2 - lat1), lng1 + rate * (lng2 - lng1))


def _reach(g: Group, at: np.ndarray, low: np.ndarray, high: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Metres that no place of a box (latitudes low to high, longitudes x0 to x1) exceeds from the points at."""
    lat, lng = g.lat[at], g.lng[at]
    up, side = np.maximum(np.abs(lat - low), np.abs(lat - high)), np.minimum(np.maximum(np.abs(lng - x0), np.abs(lng - x1)), 180.0)
    widest = np.cos(np.radians(np.where(low * high <= 0, 0.0, np.minimum(np.abs(low), np.abs(high)))))
    a = np.sin(np.radians(up) / 2) ** 2 + np.cos(np.radians(lat)) * widest * np.sin(np.radians(side) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def _boxes(g: Group) -> list[tuple[np.ndarray, ...]]:
    """Boxes of blocks of 1, 4, 16, ... points in order, up to one block of all; the last block of a level may be short."""
    now = (g.lat, g.lat, g.lng, g.lng)
    out = [now]
    while len(now[0]) > 1:
        starts = np.arange(0, len(now[0]), 4)
        now = tuple(f.reduceat(v, starts) for f, v in zip((np.minimum, np.maximum) * 2, now, strict=True))
        out.append(now)
    return out


def beyond(g: Group, max_dist: float) -> np.ndarray:
    """For each point the index of the first one after it that is farther than max_dist from it; the number of points if none.

    All points search at once. One that stands before a block whose box is near as a whole steps over it and tries a block
    four times as long where one begins there; else it tries a quarter. So a run near a point costs the logarithm of its
    length, unless its points lie about max_dist away."""
    n = len(g.micros)
    if n <= 128:
        far = np.triu(metres(g.lat[:, None], g.lng[:, None], g.lat, g.lng) > max_dist, 1)
        return np.where(far.any(1), far.argmax(1), n)
    boxes, found = _boxes(g), np.full(n, n)
    who = np.arange(n - 1)
    at, level = who + 1, np.zeros(n - 1, int)
    while len(who):
        near = np.zeros(len(who), bool)
        for k in np.unique(level):
            mine = np.flatnonzero(level == k)
            i, j = who[mine], at[mine]
            if k == 0:
                near[mine] = ~(metres(g.lat[i], g.lng[i], g.lat[j], g.lng[j]) > max_dist)
            else:
                near[mine] = _reach(g, i, *(v[j >> 2 * k] for v in boxes[k])) < max_dist * (1 - 1e-9)
        hit = ~near & (level == 0)
        found[who[hit]] = at[hit]
        at = np.where(near, at + (1 << 2 * level), at)
        rises = near & (at & ((4 << 2 * level) - 1) == 0) & (level + 1 < len(boxes))
        level = np.where(near, level + rises, level - 1)
        on = ~hit & (at < n)
        who, at, level = who[on], at[on], level[on]
    return found


def greedy_stays(g: Group, max_dist: float, max_stay_s: float) -> list[tuple[int, int]]:
    """(first, end) of stays; after one the search goes on at its end, else at the next point. The last point begins none."""
    end = beyond(g, max_dist)
    firsts = np.flatnonzero(g.micros[end - 1] - g.micros > max_stay_s * 1e6).tolist()
    out, at = [], 0
    for i in firsts:
        if i >= at and i < len(end) - 1:
            at = int(end[i])
            out.append((i, at))
    return out


def growing_stays(g: Group, max_dist: float, max_stay_s: float) -> list[tuple[int, int]]:
    """(first, end) of stays that grow as long as a member stays near points beyond the end; the one that is open at the last
    point but one is no stay."""
    ends = beyond(g, max_dist)
    long = (g.micros[ends - 1] - g.micros > max_stay_s * 1e6).tolist()
    out, first, end = [], None, -1
    for i, j in enumerate(ends[:-1].tolist()):
        if j > end and long[i]:
            first, end = (i if first is None else first), j
        if first is not None and i == end - 1:
            out.append((first, end))
            first = None
    return out


def within_speed(g: Group, max_speed: float) -> np.ndarray:
    """Indices of points that the last accepted one reaches at max_speed at most, in more than no time. Whole runs in which each
    point is reached from the one before are taken at once; behind their end the search goes in steps that double."""
    n = len(g.micros)

    def ok(i, j) -> np.ndarray:
        dt = (g.micros[j] - g.micros[i]) / 1e6
        return (dt > 0) & (metres(g.lat[i], g.lng[i], g.lat[j], g.lng[j]) <= max_speed * dt)

    breaks = np.append(np.flatnonzero(~ok(slice(0, n - 1), slice(1, n))), n - 1).tolist()  # the next point isn't reached
    kept, last, b = [], 0, 0
    while last < n:
        while breaks[b] < last:
            b += 1
        kept.append(np.arange(last, breaks[b] + 1))
        last, at, step = breaks[b], breaks[b] + 1, 4
        while at < n:
            hit = np.flatnonzero(ok(last, slice(at, at + step)))
            if len(hit):
                break
            at, step = at + step, step * 2
        last = at + int(hit[0]) if at < n else n
    return np.concatenate(kept)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of one object each, from batches sorted by the first n_keys columns."""
    open_: list[pa.RecordBatch] = []
    key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cuts = np.zeros(b.num_rows, bool)
        for k in range(n_keys):
            c = b.column(k)
            same = pc.equal(c.slice(1), c.slice(0, b.num_rows - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            nulls = c.is_null().to_numpy(zero_copy_only=False)
            cuts[1:] |= ~(same | nulls[1:] & nulls[:-1])
        ends = np.append(np.flatnonzero(cuts), b.num_rows)
        start = 0
        for end in ends.tolist():
            if end == start:
                continue
            mine = tuple(b.column(k)[start].as_py() for k in range(n_keys))
            if open_ and mine != key:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_, key, start = [*open_, b.slice(start, end - start)], mine, end
    if open_:
        yield pa.Table.from_batches(open_)


def _sorted(points: DataFrame, by) -> tuple[DataFrame, int]:
    """points with the columns in by first and microseconds last, objects together and in order; the number of columns in by."""
    rest = [c for c in points.columns if c not in by]
    (micros,) = fresh(points.columns, "micros")
    dealt = points.select(*by, *rest, F.unix_micros("time").alias(micros)).repartition(*by).sortWithinPartitions(*by, "time", "seq")
    return dealt, len(by)


def _group(t: pa.Table) -> Group:
    return Group(t.column(t.num_columns - 1).to_numpy(), t.column("lat").to_numpy(), t.column("lng").to_numpy())


def _columns(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def scan(points: DataFrame, by, kernel: Callable[[Group], list[np.ndarray]], numbered: bool = False, least: int = 1) -> DataFrame:
    """The rows of points that the kernel picks from each object, piece by piece; numbered adds part (of the piece) and pos.
    Points without a time or place are left out, and objects of which fewer than least rows are picked."""
    dealt, n_keys = _sorted(points.where("time is not null and lat is not null and lng is not null"), by)
    names = dealt.columns[:-1]
    out = [c for c in names if not numbered or c not in ("part", "pos")]
    schema = _columns(dealt, out) + (", part int, pos int" if numbered else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.Table] = []
        size = 0
        for t in _groups(batches, n_keys):
            pieces = list(kernel(_group(t)))
            if sum(map(len, pieces)) < least:
                continue
            took = t.select(out).take(pa.array(np.concatenate(pieces)))
            if numbered:
                sizes = np.array([len(p) for p in pieces])
                part = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
                pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                took = took.append_column("part", pa.array(part)).append_column("pos", pa.array(pos))
            done.append(took)
            size += took.num_rows
            if size > 10_000:
                yield from pa.concat_tables(done).combine_chunks().to_batches(max_chunksize=10_000)
                done, size = [], 0
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, schema)


def annotate(points: DataFrame, by, kernel: Callable[[Group], dict[str, np.ndarray]], kinds: dict[str, str]) -> DataFrame:
    """points with a value of the kernel's for each row, under the names and types in kinds."""
    dealt, n_keys = _sorted(points.where("time is not null and lat is not null and lng is not null"), by)
    names = [c for c in dealt.columns[:-1] if c not in kinds]
    schema = _columns(dealt, names) + "".join(f", {c} {k}" for c, k in kinds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, n_keys):
            values, out = kernel(_group(t)), t.select(names)
            for c in kinds:
                out = out.append_column(c, pa.array(values[c]))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, schema)
