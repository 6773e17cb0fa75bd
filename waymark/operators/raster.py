"""Raster operators. Sparse pixels (tile, y, x, v; zeros left out) for joins and aggregates, dense tiles for kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import stored
from . import kernels
from .network import walked_steps
from .numbering import numbered

NEAR4 = ((-1, 0), (1, 0), (0, -1), (0, 1))
NEAR8 = (*NEAR4, (-1, -1), (-1, 1), (1, -1), (1, 1))


def window_origins(width: int, height: int, size: int, stride: int, padding: bool = True) -> list[tuple[int, int]]:
    """Left upper corners of a sliding window, row by row. With padding, windows may reach over the right and lower edge."""
    steps = lambda n: [v for v in range(0, n, stride) if padding or v + size <= n]
    return [(x, y) for y in steps(height) for x in steps(width)]


def window_place(index: Column, width: int, stride: int) -> tuple[Column, Column]:
    """x and y of a numbered window of a padded grid."""
    across = -(-width // stride)
    return (index % across * stride).cast("int"), (F.floor(index / across) * stride).cast("int")


def crop(canvas: DataFrame, windows: DataFrame, size: int, stride: int) -> DataFrame:
    """Pixels of the canvas within each window (idx, wx, wy): idx, dy, dx, v. Each pixel goes to the windows that hold it, by
    arithmetic on the stride; windows are joined on their corner, so places beyond the edge simply have no pixel."""
    reach = lambda c: F.sequence(F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0)), F.floor(F.col(c) / stride))
    near = canvas.withColumn("wx", F.explode(reach("x"))).withColumn("wy", F.explode(reach("y")))
    near = near.withColumns({"wx": (F.col("wx") * stride).cast("int"), "wy": (F.col("wy") * stride).cast("int")})
    return near.join(windows, ["wx", "wy"]).select("idx", (F.col("y") - F.col("wy")).alias("dy"), (F.col("x") - F.col("wx")).alias("dx"), "v")


def region_patches(regions: DataFrame) -> DataFrame:
    """region, split to patch (4 for each region, by rows), split: patches inherit the split of their region."""
    return regions.select("region", "split", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select((F.col("region") * 4 + F.col("k")).alias("patch"), "region", "split")


def leaked_regions(patches: DataFrame) -> DataFrame:
    """Regions whose patches lie in several splits."""
    return patches.groupBy("region").agg(F.countDistinct("split").alias("n")).where("n > 1").select("region")


def to_pixels(patches: DataFrame, side: int, column: str = "pixels") -> DataFrame:
    """Sparse pixels of patches placed at (y, x) on one canvas."""
    p = patches.select("vec_id", "y", "x", F.posexplode(column).alias("k", "v")).where("v <> 0")
    return p.select("vec_id", (F.col("y") + F.floor(F.col("k") / side)).cast("int").alias("y"), (F.col("x") + F.col("k") % side).cast("int").alias("x"), "v")


def stitch(pixels: DataFrame) -> DataFrame:
    """The largest value at each place of the canvas."""
    return pixels.groupBy("y", "x").agg(F.max("v").alias("v"))


def binarise(values: Column, threshold: float, high: int = 1) -> Column:
    return F.transform(values, lambda v: F.when(v > threshold, high).otherwise(0))


def dilate(pixels: DataFrame) -> DataFrame:
    """Every pixel spread over its 3 by 3 surroundings."""
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    return pixels.select("y", "x", F.explode(around).alias("d")).select((F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()


def close3(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Closing by a 3 by 3 square: dilation, then erosion; outside of the canvas nothing is eroded."""
    wide = dilate(pixels).where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height) & (F.col("x") < width))
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    votes = wide.select("y", "x", F.explode(around).alias("d")).select((F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    votes = votes.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height) & (F.col("x") < width)).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))
    rows = F.when((F.col("y") == 0) | (F.col("y") == height - 1), 2 if height > 1 else 1).otherwise(3)
    cols = F.when((F.col("x") == 0) | (F.col("x") == width - 1), 2 if width > 1 else 1).otherwise(3)
    return votes.where(F.col("n") == rows * cols).select("y", "x")


def pixel_graph(pixels: DataFrame) -> DataFrame:
    """Edges (tile, y, x, ny, nx), both ways: side neighbours always, corner ones only without a common side neighbour."""
    p = pixels.select("tile", "y", "x").distinct()
    step = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NEAR8])
    want = p.select("tile", "y", "x", F.explode(step).alias("d")).select("tile", "y", "x", (F.col("y") + F.col("d.dy")).alias("ny"), (F.col("x") + F.col("d.dx")).alias("nx"))
    there = p.withColumnsRenamed({"y": "ny", "x": "nx"})
    found = want.join(there, ["tile", "ny", "nx"])
    side = (F.col("y") == F.col("ny")) | (F.col("x") == F.col("nx"))
    corner = found.where(~side)
    for a, b in (("ny", "x"), ("y", "nx")):
        corner = corner.join(p.withColumnsRenamed({"y": a, "x": b}), ["tile", a, b], "left_anti")
    return found.where(side).select("tile", "y", "x", "ny", "nx").unionByName(corner.select("tile", "y", "x", "ny", "nx"))


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected pixels, 0 outside."""
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        n += 1
        stack, labels[y, x] = [(y, x)], n
        while stack:
            a, b = stack.pop()
            for dy, dx in NEAR4:
                c, d = a + dy, b + dx
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not labels[c, d]:
                    labels[c, d] = n
                    stack.append((c, d))
    return labels


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels = components(mask)
    size = np.bincount(labels.ravel())
    return (labels > 0) & (size[labels] >= least)


def _thin_round(m: np.ndarray) -> bool:
    """One round (both phases) on a padded mask, in place; whether a pixel went."""
    changed = False
    for phase in (0, 1):
        p = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # north, then clockwise
        n = sum(x.astype(np.int8) for x in p)
        turns = sum((~p[k] & p[(k + 1) % 8]).astype(np.int8) for k in range(8))
        a, b = (p[0] & p[2] & p[4], p[2] & p[4] & p[6]) if phase == 0 else (p[0] & p[2] & p[6], p[0] & p[4] & p[6])
        gone = m & (n >= 2) & (n <= 6) & (turns == 1) & ~a & ~b
        if gone.any():
            m &= ~gone
            changed = True
    return changed


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning (1984)."""
    m = np.pad(mask.astype(bool), 1)
    while _thin_round(m):
        pass
    return m[1:-1, 1:-1]


def _by_tiles(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], tile: int, margin: int) -> DataFrame:
    """A kernel from mask to mask over a canvas (y, x), where each pixel's result depends on a margin around it alone.

    Every pixel goes to the tiles whose margin holds it (four at most if a tile is twice its margin); a tile returns its own
    pixels. A group has (tile + 2 * margin)^2 pixels at most, whatever the canvas. Pixels are distinct."""
    if tile < 2 * margin:
        raise ValueError("a tile must be at least twice as wide as its margin")
    side = tile + 2 * margin
    types = [pixels.schema[c].dataType.simpleString() for c in ("y", "x")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = (int(k) * tile - margin for k in key)
        m = np.zeros((side, side), bool)
        m[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = True
        y, x = np.nonzero(kernel(m)[margin : margin + tile, margin : margin + tile])
        return pd.DataFrame({"y": y + y0 + margin, "x": x + x0 + margin})

    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile)))
    placed = pixels.select("y", "x").withColumn("ty", near("y")).withColumn("tx", near("x"))
    return placed.groupBy("ty", "tx").applyInPandas(run, f"y {types[0]}, x {types[1]}")


def drop_small_pixels(pixels: DataFrame, least: int, tile: int = 256) -> DataFrame:
    """A canvas (y, x) without its 4-connected objects of fewer than least pixels.

    From a pixel whose object is smaller, no path of least steps leads away: with a margin of least pixels each tile sees such
    an object whole, and at least least pixels of any other. One pass is exact."""
    tile = max(tile, 2 * least)
    return _by_tiles(pixels.select("y", "x").distinct(), lambda m: drop_small(m, least), tile, least)


def thin_pixels(pixels: DataFrame, tile: int = 256, at_once: int = 16) -> DataFrame:
    """Zhang and Suen's thinning of a whole canvas (y, x), however large, exactly as thin() does it.

    What a pixel becomes in a half round depends on its eight neighbours alone, so at_once rounds depend on a margin of
    2 * at_once pixels. Passes of at_once rounds repeat until no pixel goes: once for shapes narrower than 2 * at_once, and
    once more to see it."""

    def rounds(mask: np.ndarray) -> np.ndarray:
        m = np.pad(mask, 1)  # nothing is set on the rim
        for _ in range(at_once):
            if not _thin_round(m):
                break
        return m[1:-1, 1:-1]

    now = stored(pixels.select("y", "x").distinct(), "thin")
    n = now.count()
    while n:
        now = stored(_by_tiles(now, rounds, tile, 2 * at_once), "thin")
        left = now.count()
        if left == n:
            break
        n = left
    return now


def trace(edges: set[tuple[tuple[int, int], tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Pixel graph to lines: nodes are pixels whose degree is not 2, lines follow the others; pure rings are closed lines."""
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    used, lines = set(), []

    def follow(a, b):
        line = [a, b]
        used.update({(a, b), (b, a)})
        while len(near[line[-1]]) == 2 and line[-1] != a:
            c = next(x for x in sorted(near[line[-1]]) if x != line[-2])
            used.update({(line[-1], c), (c, line[-1])})
            line.append(c)
        return line

    for a in sorted(n for n in near if len(near[n]) != 2):
        lines += [follow(a, b) for b in sorted(near[a]) if (a, b) not in used]
    for a in sorted(near):
        lines += [follow(a, b) for b in sorted(near[a])[:1] if (a, b) not in used]
    return lines


def kept_points(n: int, off: Callable[[int, int], np.ndarray], epsilon: float, short: int = 4) -> np.ndarray:
    """Which of n points Douglas and Peucker's simplification keeps; off tells how far the points between two are off their line.

    A piece is cut at its farthest point (of equal ones the first) if that is epsilon or more away; pieces of up to short points
    stay as they are. Open pieces wait on a list, so lines may be of any length."""
    keep, open_ = np.zeros(n, bool), [(0, n - 1)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < short:
            keep[lo : hi + 1] = True
            continue
        keep[[lo, hi]] = True
        far = off(lo, hi)
        k = int(far.argmax())
        if far[k] >= epsilon:
            open_ += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return keep


def simplify(line: list[tuple[float, float]], epsilon: float, short: int = 4) -> list[tuple[float, float]]:
    """A line in the plane by kept_points."""
    p = np.array(line, float).reshape(-1, 2)

    def off(lo: int, hi: int) -> np.ndarray:
        (y0, x0), (y1, x1), q = p[lo], p[hi], p[lo + 1 : hi]
        length = np.hypot(y1 - y0, x1 - x0)
        return np.hypot(q[:, 0] - y0, q[:, 1] - x0) if length == 0 else np.abs((y1 - y0) * (q[:, 1] - x0) - (x1 - x0) * (q[:, 0] - y0)) / length

    return [line[k] for k in np.flatnonzero(kept_points(len(line), off, epsilon, short))]


def simplify_coords(lines: DataFrame, metres: float, coords: str = "coords") -> DataFrame:
    """lines with coords (array of struct(lat, lng)) simplified: points less than so many metres off the line between their
    neighbours go. Lines of up to four points and null ones stay; points without a place go first. A task holds one batch of
    lines as arrays of numbers."""
    names = lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(names.index(coords))
            places, cuts = c.values, c.offsets.to_numpy()
            lat, lng = (places.field(k).to_numpy(zero_copy_only=False) for k in ("lat", "lng"))
            taken, ends = [], [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = lo + np.flatnonzero(~(np.isnan(lat[lo:hi]) | np.isnan(lng[lo:hi])))
                y, x = lat[at], lng[at]
                off = lambda i, j, y=y, x=x: kernels.off_line(y[i], x[i], y[j], x[j], y[i + 1 : j], x[i + 1 : j])
                taken.append(at[kept_points(len(at), off, metres)])
                ends.append(ends[-1] + len(taken[-1]))
            kept = places.take(pa.array(np.concatenate(taken) if taken else np.zeros(0, np.int64)))
            bent = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept, type=c.type, mask=c.is_null())
            yield pa.RecordBatch.from_arrays([bent if n == coords else b.column(k) for k, n in enumerate(names)], names=names)

    return lines.mapInArrow(run, lines.schema)


def overlap_scores(pred: Column, truth: Column) -> Column:
    """struct(p, r, f1, iou) of two arrays at threshold 0.5; all 0 where they hardly meet."""
    both = F.aggregate(F.zip_with(pred, truth, lambda a, b: ((a > 0.5) & (b > 0.5)).cast("int")), F.lit(0), lambda s, v: s + v).cast("double")
    n = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + (v > 0.5).cast("int")).cast("double")
    a, b = n(pred), n(truth)
    none = both / F.size(pred) < 1e-10
    z = lambda v: F.when(none, 0.0).otherwise(v)
    return F.struct(z(both / a).alias("p"), z(both / b).alias("r"), z(2 * both / (a + b)).alias("f1"), z(both / (a + b - both)).alias("iou"))


def bce_loss(pred: Column, truth: Column) -> Column:
    """Mean binary cross-entropy, logarithms clamped at 1e-8."""
    ln = lambda v: F.ln(F.greatest(v, F.lit(1e-8)))
    parts = F.zip_with(pred, truth, lambda p, t: -(t * ln(p) + (1 - t) * ln(1 - p)))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(pred)


def dice_loss(pred: Column, truth: Column, smooth: float = 1.0) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return 1 - (2 * total(F.zip_with(pred, truth, lambda p, t: p * t)) + smooth) / (total(pred) + total(truth) + smooth)


def lines_to_pixels(lines: DataFrame) -> DataFrame:
    """Pixels of straight lines (tile, y1, x1, y2, x2): one per step along the longer side."""
    n = F.greatest(F.abs(F.col("y2") - F.col("y1")), F.abs(F.col("x2") - F.col("x1")), F.lit(1))
    s = lines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n") + 0.5).cast("int")
    return s.select("tile", at("y1", "y2").alias("y"), at("x1", "x2").alias("x")).distinct()


def split_by_hash(ids: DataFrame, column: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """id, split: a seeded random order cut at the ratios, without gathering the ids: the hash itself is compared with the cuts."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return ids.select(column, F.when(u < train, "train").when(u < train + val, "val").otherwise("test").alias("split"))


def resample(canvas: DataFrame, regions: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """A size by size view of each region (region, y0, y1, x0, x1: canvas rows and columns) by the nearest pixel: region, i, j, v
    (0 where nothing is set)."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    grid = regions.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    near = lambda k, a, b, n: F.least(F.greatest(F.rint(F.col(a) + (F.col(k) + 0.5) / size * (F.col(b) - F.col(a)) - 0.5), F.lit(0.0)), F.lit(float(n - 1))).cast("int")
    g = grid.select("region", "i", "j", near("i", "y0", "y1", height).alias("y"), near("j", "x0", "x1", width).alias("x"))
    return g.join(canvas.select("y", "x", "v"), ["y", "x"], "left").select("region", "i", "j", F.coalesce("v", F.lit(0)).alias("v"))


def resample_mercator(canvas: DataFrame, box: tuple[float, float, float, float], height: int, width: int, regions: DataFrame, size: int) -> DataFrame:
    """As resample, from a canvas in Mercator projection over a box of degrees (min_lat, min_lng, max_lat, max_lng) to regions
    (region, box: struct(min_lat, max_lat, min_lng, max_lng)) whose rows are even in degrees: each row and column of a region is
    taken to its place on the projection, and the nearest pixel (half to even, within the canvas) is read."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    grid = regions.select("region", "box", F.explode(steps).alias("i")).withColumn("j", F.explode(steps))
    x, y = geo.geo_to_pixel(*geo.rc_to_geo(F.col("i"), F.col("j"), F.col("box"), size), box, width, height)
    near = lambda v, n: F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(float(n - 1))).cast("int")
    g = grid.select("region", "i", "j", near(y, height).alias("y"), near(x, width).alias("x"))
    return g.join(canvas.select("y", "x", "v"), ["y", "x"], "left").select("region", "i", "j", F.coalesce("v", F.lit(0)).alias("v"))


def crop_bilinear(canvas: DataFrame, regions: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """A size by size view of each region (region, y0, y1, x0, x1: whole rows and columns, the ends not included) between pixels:
    region, i, j, v (double). Regions are cut to the canvas; those outside of it have no rows.

    Centres of pixels lie half a pixel off their corners. Each place weighs the four pixels around it, at the rim those that are
    there; they are gathered by one join on the pixel and one sum."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    own = [F.greatest("y0", F.lit(0)).alias("y0"), F.least("y1", F.lit(height)).alias("y1"), F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.lit(width)).alias("x1")]
    grid = regions.select("region", *own).where("y1 > y0 and x1 > x0").withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))

    def sides(k: str, a: str, b: str):
        """Both pixels along one axis with their weights."""
        n = F.col(b) - F.col(a)
        at = F.least(F.greatest((F.col(k) + 0.5) / size * n - 0.5, F.lit(0.0)), (n - 1).cast("double"))
        low = F.floor(at)
        pair = lambda up, w: F.struct((F.col(a) + low + up).cast("int").alias("at"), w.alias("w"))
        return F.array(pair(0, 1 - (at - low)), pair(1, at - low))

    near = grid.select("region", "i", "j", F.explode(sides("i", "y0", "y1")).alias("p"), sides("j", "x0", "x1").alias("q"))
    near = near.select("region", "i", "j", "p", F.explode("q").alias("q")).select("region", "i", "j", F.col("p.at").alias("y"), F.col("q.at").alias("x"), (F.col("p.w") * F.col("q.w")).alias("w"))
    read = near.where("w > 0").join(canvas.select("y", "x", "v"), ["y", "x"], "left")
    return read.groupBy("region", "i", "j").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("v"))


def random_corners(draws: DataFrame, column: str, subset: Column, width: int, height: int, size: int, split: float = 0.8, seed: int = 42) -> DataFrame:
    """draws with subset, wx, wy: a seeded corner of a window for each row. Windows of "train" lie above the cut at split, those
    of "val" below it, those of any other subset anywhere; the last row and column of the canvas are never reached."""
    cut = int(split * height)
    if width <= size or height <= size or cut > height - size - 1:
        raise ValueError("the canvas has no room for such windows")
    u = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string"))), k, 8), 16, 10).cast("long")
    low = F.when(F.col("subset") == "val", cut).otherwise(0)
    high = F.when(F.col("subset") == "train", max(0, cut - size - 1)).otherwise(height - size - 1)
    placed = draws.withColumn("subset", subset)
    return placed.withColumns({"wx": (u(1) % (width - size)).cast("int"), "wy": (low + u(9) % (high - low + 1)).cast("int")})


def cut_windows(layers: DataFrame, windows: DataFrame, size: int, names: list[str]) -> DataFrame:
    """windows (idx, wx, wy and others) with one dense array, row by row, for each named layer of the canvas (layer, y, x, v).

    Windows lie anywhere: both sides meet in blocks of the size of a window, of which a window touches four at most."""
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    near = F.array(*[F.struct((block("wy") + i).alias("by"), (block("wx") + j).alias("bx")) for i in (0, 1) for j in (0, 1)])
    asked = windows.select("idx", "wx", "wy", F.explode(near).alias("b")).select("idx", "wx", "wy", "b.by", "b.bx")
    dy, dx = F.col("y") - F.col("wy"), F.col("x") - F.col("wx")
    met = asked.join(layers.select("layer", "y", "x", "v", block("y").alias("by"), block("x").alias("bx")), ["by", "bx"])
    inside = met.where(dy.between(0, size - 1) & dx.between(0, size - 1)).groupBy("idx", "layer", (dy * size + dx).alias("k")).agg(F.max("v").alias("v"))
    parts = inside.groupBy("idx").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("layer") == n, F.struct("k", "v")))).alias(f"has_{n}") for n in names])
    dense = lambda n: F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.col(f"has_{n}")[k], F.lit(0)))
    return windows.join(parts, "idx", "left").select(*windows.columns, *[dense(n).alias(n) for n in names])


def without_buildings(channel: Column, building: Column, mark: int = 2) -> Column:
    """The channel with 0 where the building layer has the mark."""
    return F.zip_with(channel, building, lambda c, b: F.when(b == mark, 0).otherwise(c))


def fill_polygons(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """polygons (ring: array of struct(y, x) in pixels, first corner not repeated) with y, x of each pixel whose centre is inside
    by the even-odd rule; ring is dropped. Rings of fewer than three corners, or null ones, have none."""
    closed = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda p, q: F.struct(p["y"].alias("y1"), p["x"].alias("x1"), q["y"].alias("y2"), q["x"].alias("x2")))
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    ys = F.transform("ring", lambda p: p["y"])
    first = F.greatest(F.floor(F.array_min(ys)).cast("int"), F.lit(0))
    rows = polygons.where("size(ring) > 2").withColumns({"sides_": closed, "y": F.explode(run(first, F.least(F.floor(F.array_max(ys)).cast("int"), F.lit(height - 1))))})
    at = F.col("y") + 0.5
    cut = F.filter("sides_", lambda s: (s["y1"] <= at) != (s["y2"] <= at))
    spots = F.array_sort(F.transform(cut, lambda s: s["x1"] + (at - s["y1"]) / (s["y2"] - s["y1"]) * (s["x2"] - s["x1"])))
    rows = rows.withColumn("spots_", spots).where("size(spots_) > 1")
    rows = rows.withColumn("k_", F.explode(F.sequence(F.lit(1), F.size("spots_") - 1, F.lit(2))))
    a, b = F.element_at("spots_", F.col("k_")), F.element_at("spots_", F.col("k_") + 1)
    x = F.explode(run(F.greatest(F.ceil(a - 0.5).cast("int"), F.lit(0)), F.least(F.ceil(b - 0.5).cast("int") - 1, F.lit(width - 1))))
    return rows.select(*[c for c in polygons.columns if c != "ring"], "y", x.alias("x"))


def trace_pixels(graph: DataFrame) -> DataFrame:
    """Pixel graph of a whole canvas (y, x, ny, nx, both ways) to lines (first, second, points: array of struct(y, x)).

    Lines run between pixels whose degree is not 2, over those of degree 2; a ring is one closed line from its least pixel. Each
    line is told once, from the lesser of its ends. The number of rounds is the logarithm of the longest line; only one
    line's own pixels ever meet in a row."""
    key = lambda y, x: F.shiftleft(F.col(y).cast("long"), 32) + F.col(x)
    e = stored(graph.select(key("y", "x").alias("a"), key("ny", "nx").alias("b")).distinct(), "pixel-steps")
    inner = e.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi")).where("n = 2").drop("n")
    steps = e.join(inner, "b", "left").select("a", "b", F.when(F.col("lo") == F.col("a"), F.col("hi")).otherwise(F.col("lo")).alias("c"))
    walked, rings = walked_steps(steps)
    rings = stored(rings, "rings")
    if not rings.isEmpty():
        again = rings.join(inner, "b").select("a", "b", F.when(F.col("b") != F.col("low"), F.when(F.col("lo") == F.col("a"), F.col("hi")).otherwise(F.col("lo"))).alias("c"))
        walked = walked.unionByName(walked_steps(again)[0])
    lines = walked.groupBy("ja", "jb").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("k"), "a"))), lambda s: s["a"]).alias("p"))
    lines = lines.withColumn("p", F.concat("p", F.array("jb")))
    first, second = F.element_at("p", 1), F.element_at("p", 2)
    once = lines.where(F.struct(first, second) <= F.struct(F.element_at("p", -1), F.element_at("p", -2)))
    place = lambda p: F.struct(F.shiftright(p, 32).cast("int").alias("y"), p.bitwiseAND(0xFFFFFFFF).cast("int").alias("x"))
    return once.select(first.alias("first"), second.alias("second"), F.transform("p", place).alias("points"))


def bent_lines(lines: DataFrame, epsilon: float, short: int = 4) -> DataFrame:
    """Traced lines (first, second, points) simplified: first, second, ys, xs."""

    def run(batches):
        for pdf in batches:
            bent = [simplify([(p["y"], p["x"]) for p in line], epsilon, short) for line in pdf.points]
            yield pd.DataFrame({"first": pdf["first"], "second": pdf["second"], "ys": [[int(p[0]) for p in b] for b in bent], "xs": [[int(p[1]) for p in b] for b in bent]})

    return lines.mapInPandas(run, "first long, second long, ys array<int>, xs array<int>")


def lines_to_network(lines: DataFrame, north: float, west: float, degrees: float, epsilon: float = 2.0) -> DataFrame:
    """Traced lines to edges (eid, u, v, coords, length): simplified (points within epsilon pixels go), placed by the corner of
    the canvas and the width of a pixel. Of lines between the same ends the one traced from the least pixels stays."""
    bent = bent_lines(lines, float(np.nextafter(epsilon, np.inf)), 2)
    pixel = lambda k: F.shiftleft(F.element_at("ys", k).cast("long"), 32) + F.element_at("xs", k)
    coords = F.zip_with("ys", "xs", lambda y, x: F.struct((F.lit(north) - y * degrees).alias("lat"), (F.lit(west) + x * degrees).alias("lng")))
    e = bent.select("first", "second", pixel(1).alias("u"), pixel(-1).alias("v"), coords.alias("coords")).where("u <> v or size(coords) > 2")
    ends = [F.least("u", "v"), F.greatest("u", "v")]
    e = e.groupBy(*[c.alias(n) for c, n in zip(ends, ("e0", "e1"), strict=True)]).agg(F.min(F.struct("first", "second", "u", "v", "coords")).alias("s")).select("s.*")
    return numbered(e, [F.col("first"), F.col("second")], "eid").select("eid", "u", "v", "coords", geo.length_m(F.col("coords")).alias("length"))


def skeleton_lines(mask: DataFrame, least: int = 1) -> DataFrame:
    """The lines (first, second, points) of a binary canvas (y, x): objects under least pixels out, thinned and traced as a whole."""
    return trace_pixels(pixel_graph(thin_pixels(drop_small_pixels(mask, least) if least > 1 else mask).withColumn("tile", F.lit(0))))


def mask_to_network(mask: DataFrame, north: float, west: float, degrees: float, epsilon: float = 2.0, least: int = 1) -> DataFrame:
    """A binary canvas (y, x) to a road network: objects under least pixels out, thinned, traced, simplified and placed, all over
    the whole canvas."""
    return lines_to_network(skeleton_lines(mask, least), north, west, degrees, epsilon)
