"""Grids and spatial joins: cells on both sides, an equi-join on the cell, then the exact predicate."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import stored
from .naming import fresh

#: Metres of a degree of latitude, a little less than it has, so that boxes have some room.
DEGREE_M = 110_000.0
#: No box reaches farther towards a pole than its longitudes are widened for.
FARTHEST = 89.9


@dataclass(frozen=True)
class Grid:
    """rows by columns over a box (min_lat, min_lng, max_lat, max_lng); row 0 is the south, matrix row 0 the north."""

    box: tuple[float, float, float, float]
    rows: int
    columns: int

    @property
    def steps(self) -> tuple[float, float]:
        return (self.box[2] - self.box[0]) / self.rows, (self.box[3] - self.box[1]) / self.columns

    def cell(self, lat: Column, lng: Column, strict: bool = False) -> Column:
        """struct(row, col); null outside, or an error if strict."""
        dy, dx = self.steps
        inside = geo.in_box(lat, lng, *self.box)
        c = F.struct(F.floor((lat - self.box[0]) / dy).cast("int").alias("row"), F.floor((lng - self.box[1]) / dx).cast("int").alias("col"))
        return F.when(inside, c).otherwise(F.raise_error(F.lit("outside of the grid")).cast("struct<row:int,col:int>")) if strict else F.when(inside, c)

    def matrix(self, cell: Column) -> Column:
        return F.when(cell.isNotNull(), F.struct((self.rows - 1 - cell["row"]).alias("row"), cell["col"].alias("col")))

    def bounds(self, row: Column, col: Column) -> Column:
        dy, dx = self.steps
        return F.struct((self.box[0] + row * dy).alias("min_lat"), (self.box[1] + col * dx).alias("min_lng"), (self.box[0] + (row + 1) * dy).alias("max_lat"), (self.box[1] + (col + 1) * dx).alias("max_lng"))

    def covered(self, min_lat: Column, min_lng: Column, max_lat: Column, max_lng: Column) -> Column:
        """Array of struct(row, col) that a box covers, clipped to the grid; its upper sides are open."""
        dy, dx = self.steps
        tiny = 1e-7
        lo = lambda v, at: F.greatest(v, F.lit(at))
        hi = lambda v, at: F.least(v, F.lit(at)) - tiny
        r0, r1 = F.floor((lo(min_lat, self.box[0]) - self.box[0]) / dy).cast("int"), F.floor((hi(max_lat, self.box[2]) - self.box[0]) / dy).cast("int")
        c0, c1 = F.floor((lo(min_lng, self.box[1]) - self.box[1]) / dx).cast("int"), F.floor((hi(max_lng, self.box[3]) - self.box[1]) / dx).cast("int")
        cells = F.flatten(F.transform(F.sequence(r0, r1), lambda r: F.transform(F.sequence(c0, c1), lambda c: F.struct(r.alias("row"), c.alias("col")))))
        return F.when((r1 >= r0) & (c1 >= c0), cells).otherwise(F.array().cast("array<struct<row:int,col:int>>"))


def cells_of(min_lat, min_lng, max_lat, max_lng, degrees) -> Column:
    """Keys of the square cells that a box meets."""
    at = lambda v: F.floor(v / degrees).cast("long")
    rows, cols = F.sequence(at(min_lat), at(max_lat)), F.sequence(at(min_lng), at(max_lng))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: r * 1_000_000 + c)))


def with_box(edges: DataFrame) -> DataFrame:
    """Adds the box of coords as y0, x0, y1, x1."""
    lats, lngs = F.transform("coords", lambda p: p["lat"]), F.transform("coords", lambda p: p["lng"])
    return edges.withColumns({"y0": F.array_min(lats), "x0": F.array_min(lngs), "y1": F.array_max(lats), "x1": F.array_max(lngs)})


def box_join(boxes: DataFrame, edges: DataFrame, degrees: float = 0.002, levels: int = 1, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose boxes (b0, b1, b2, b3 = min lat, min lng, max lat, max lng; y0, x0, y1, x1) meet and that agree in
    the columns in on, each once.

    Of the cells that both share, the pair is made in the one that holds the lower corner of the common box, so nothing
    has to be deduplicated. With several levels, cells grow fourfold from level to level; a row belongs to the first level
    where it spans three cells at most each way (or the last one) and is offered there and above, and a pair is made on the
    higher of both levels, so that wide boxes are not cut into all their small cells.
    """
    cell, level, own_a, own_b = fresh([*boxes.columns, *edges.columns], "cell", "level", "own_a", "own_b")
    size = lambda k: F.lit(degrees) * F.pow(F.lit(4.0), k)

    def placed(df: DataFrame, y0: str, x0: str, y1: str, x1: str, own: str) -> DataFrame:
        if levels == 1:
            return df.withColumn(cell, F.explode(cells_of(F.col(y0), F.col(x0), F.col(y1), F.col(x1), degrees)))
        span = F.greatest(F.col(y1) - F.col(y0), F.col(x1) - F.col(x0), F.lit(1e-12))
        first = F.least(F.greatest(F.ceil(F.log(4.0, span / (2 * degrees))), F.lit(0)), F.lit(levels - 1)).cast("int")
        up = df.withColumn(own, first).withColumn(level, F.explode(F.sequence(F.col(own), F.lit(levels - 1))))
        return up.withColumn(cell, F.explode(cells_of(F.col(y0), F.col(x0), F.col(y1), F.col(x1), size(F.col(level)))))

    a, b = placed(boxes, "b0", "b1", "b2", "b3", own_a), placed(edges, "y0", "x0", "y1", "x1", own_b)
    wide = F.lit(degrees) if levels == 1 else size(F.col(level))
    corner = F.floor(F.greatest("b0", "y0") / wide).cast("long") * 1_000_000 + F.floor(F.greatest("b1", "x0") / wide).cast("long")
    meets = (F.col("b0") <= F.col("y1")) & (F.col("y0") <= F.col("b2")) & (F.col("b1") <= F.col("x1")) & (F.col("x0") <= F.col("b3"))
    if levels == 1:
        return a.join(b, [*on, cell]).where(meets & (F.col(cell) == corner)).drop(cell)
    return a.join(b, [*on, level, cell]).where(meets & (F.col(cell) == corner) & (F.col(level) == F.greatest(own_a, own_b))).drop(cell, level, own_a, own_b)


#: Of box_counts: asked boxes of a block, rows of boxes compared with them at once, and rows of boxes to a slice.
BLOCK, PIECE, SLICE = 1024, 2048, 2_000_000


def _counted(asked: np.ndarray, boxes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many boxes (y0, x0, y1, x1; by owner) meet each asked one, and of how many owners."""
    n, n_owners = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    b0, b1, b2, b3 = asked.T
    before, seen = None, None
    for at in range(0, len(boxes), PIECE):
        y0, x0, y1, x1 = boxes[at : at + PIECE].T[:, :, None]
        own = owners[at : at + PIECE]
        meets = (b0 <= y1) & (y0 <= b2) & (b1 <= x1) & (x0 <= b3)
        n += np.count_nonzero(meets, axis=0)
        by_owner = np.logical_or.reduceat(meets, np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), axis=0)
        n_owners += np.count_nonzero(by_owner, axis=0)
        if before == own[0]:  # counted in the piece before already
            n_owners -= seen & by_owner[0]
            by_owner[0] |= seen
        before, seen = own[-1], by_owner[-1]
    return n, n_owners


def box_counts(asked: DataFrame, boxes: DataFrame, degrees: float = 0.002, slice_rows: int = SLICE) -> DataFrame:
    """asked, n, n_owners: how many boxes (owner long, y0, x0, y1, x1) meet each asked box (asked long, b0, b1, b2, b3), and of how
    many owners; asked boxes that none meets are left out.

    No pair is made a row: boxes are joined with blocks of asked boxes that lie close to each other, and a task compares a block
    with the boxes near it, of one slice of the owners, a piece at a time.
    """
    boxes = stored(boxes.select("owner", "y0", "x0", "y1", "x1"), "boxes")
    slices = max(1, -(-boxes.count() // slice_rows))
    boxes = boxes.withColumn("slice", F.pmod(F.xxhash64("owner"), F.lit(slices)).cast("int"))
    at = lambda lo, hi: F.floor((F.col(lo) + F.col(hi)) / (2 * degrees)).cast("long")
    cell = F.struct(at("b0", "b2").alias("row"), at("b1", "b3").alias("col"))
    number = F.row_number().over(Window.partitionBy("cell").orderBy("b0", "b1", "asked")) - 1
    dealt = stored(asked.select("asked", "b0", "b1", "b2", "b3").withColumn("cell", cell).withColumn("block", F.struct("cell.row", "cell.col", F.floor(number / BLOCK).alias("part"))).drop("cell"), "asked")
    each = lambda df: df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    blocks = dealt.groupBy("block").agg(F.min("b0").alias("b0"), F.min("b1").alias("b1"), F.max("b2").alias("b2"), F.max("b3").alias("b3"))
    near = box_join(each(blocks), boxes, degrees, levels=6, on=("slice",)).select(F.col("block").alias("at"), F.col("slice").alias("of"), "owner", "y0", "x0", "y1", "x1")

    def run(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("owner")
        n, n_owners = _counted(asked[["b0", "b1", "b2", "b3"]].to_numpy(), near[["y0", "x0", "y1", "x1"]].to_numpy(), near.owner.to_numpy())
        return pd.DataFrame({"asked": asked.asked.to_numpy(), "n": n, "n_owners": n_owners})[n > 0]

    parts = each(dealt).groupBy("block", "slice").cogroup(near.groupBy("at", "of")).applyInPandas(run, "asked long, n long, n_owners long")
    return parts.groupBy("asked").agg(F.sum("n").alias("n"), F.sum("n_owners").alias("n_owners"))


def lng_degrees(lat: Column, metres: Column | float) -> Column:
    """Degrees of longitude that so many metres have at most anywhere within that distance of a latitude."""
    farther = F.least(F.abs(lat) + metres / DEGREE_M, F.lit(FARTHEST))
    return metres / (DEGREE_M * F.cos(F.radians(farther)))


def around(points: DataFrame, metres: float) -> DataFrame:
    up, side = metres / DEGREE_M, lng_degrees(F.col("lat"), metres)
    return points.withColumns({"b0": F.col("lat") - up, "b1": F.col("lng") - side, "b2": F.col("lat") + up, "b3": F.col("lng") + side})


def candidates(points: DataFrame, edges: DataFrame, metres: float) -> DataFrame:
    """points with eid, u, v, length, error, offset, proj_lat, proj_lng, i of each edge within so many metres."""
    own = with_box(edges.select("eid", "u", "v", "coords", "length"))
    # What explode(array()) makes is computed once; the filter would repeat it otherwise.
    near = box_join(around(points, metres), own).withColumn("_n", F.explode(F.array(geo.nearest_on_polyline(F.col("coords"), F.col("lat"), F.col("lng"))))).where(F.col("_n.dist") <= metres)
    before = geo.length_m(F.slice("coords", 1, F.col("_n.i") + 1))
    # The struct is a column of its own by now, so its parts are not computed again.
    at = F.element_at("coords", F.col("_n.i") + 1)
    offset = before + geo.haversine_m(at["lat"], at["lng"], F.col("_n.lat"), F.col("_n.lng"))
    return near.select(*points.columns, "eid", "u", "v", "length", F.col("_n.dist").alias("error"), offset.alias("offset"), F.col("_n.lat").alias("proj_lat"), F.col("_n.lng").alias("proj_lng"), F.col("_n.i").alias("i"))


def nearest(points: DataFrame, key: list[str], others: DataFrame, k: int, metres: float) -> DataFrame:
    """The k nearest of others (node, y, x) within so many metres of each point: key, node, dist, rank. Ties by node."""
    o = others.select("node", "y", "x").withColumns({"y0": F.col("y"), "x0": F.col("x"), "y1": F.col("y"), "x1": F.col("x")})
    near = box_join(around(points.select(*key, "lat", "lng"), metres), o).withColumn("dist", geo.haversine_m(F.col("lat"), F.col("lng"), F.col("y"), F.col("x"))).where(F.col("dist") <= metres)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("dist", "node"))).where(F.col("rank") <= k).select(*key, "node", "dist", "rank")


def nearest_any(points: DataFrame, key: list[str], others: DataFrame, k: int, metres: float) -> DataFrame:
    """The k nearest of others at any distance: points with fewer than k within so many metres are asked again with four times
    the radius, until all have k, or the whole of others if those are fewer. Points without a place have none."""
    asked, found, n_others = stored(points.where("lat is not null and lng is not null").select(*key, "lat", "lng"), "asked"), [], others.limit(k).count()
    while n_others:
        near = stored(nearest(asked, key, others, k, metres), "nearest")
        full = near.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_others).select(*key)
        found.append(near.join(full, key, "left_semi"))
        asked = stored(asked.join(full, key, "left_anti"), "asked")
        if asked.isEmpty():
            break
        metres *= 4
        if metres > 2.1e7:  # half the way round the earth: all are near
            raise ValueError("others without a place")
    return functools.reduce(DataFrame.union, found) if found else nearest(points, key, others, k, metres)
