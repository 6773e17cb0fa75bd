"""Operators on point tables (oid, seq, time, lat, lng, ...): filters, segmentation, stay points and measures.

Points of an object are ordered by (time, seq). Window operators partition by object. Sequential ones stream over batches of
sorted points (kernels.py) and hold one object's points at a time as arrays of numbers; segment by time first, or add a time
chunk to `by`, where an object's points outgrow a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.temporal import seconds_between
from . import kernels
from .naming import fresh

BY = ("oid",)


def ordered(by=BY):
    return Window.partitionBy(*by).orderBy("time", "seq")


def whole(by=BY):
    return Window.partitionBy(*by)


def with_previous(points: DataFrame, by=BY) -> DataFrame:
    """Adds dt (seconds) and dist (metres) from the point before; null at the first."""
    w = ordered(by)
    prev = {c: F.lag(c).over(w) for c in ("time", "lat", "lng")}
    return points.withColumns({"dt": seconds_between(F.col("time"), prev["time"]), "dist": geo.haversine_m(prev["lat"], prev["lng"], F.col("lat"), F.col("lng"))}).withColumn("dist", F.when(F.col("dt").isNotNull(), F.col("dist")))


def at_least(points: DataFrame, n: int, by=BY) -> DataFrame:
    """Only the groups of n points or more."""
    (name,) = fresh(points.columns, "n_points")
    return points.withColumn(name, F.count(F.lit(1)).over(whole(by))).where(F.col(name) >= n).drop(name)


def trajectory_id(oid: Column, first: Column, last: Column, pattern: str = "yyyyMMddHHmmss") -> Column:
    """oid_start_end. Filters and paths use minutes: pattern yyyyMMddHHmm."""
    return F.concat_ws("_", oid.cast("string"), F.date_format(first, pattern), F.date_format(last, pattern))


# -- filters


def range_filter(points: DataFrame, box, start: str, end: str, by=BY) -> DataFrame:
    """Points in a half-open box and time range; groups of fewer than two points, before or after, go."""
    t = F.col("time")
    kept = at_least(points, 2, by).where((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")) & geo.in_box(F.col("lat"), F.col("lng"), *box))
    return at_least(kept, 2, by)


def speed_filter(points: DataFrame, max_speed: float, by=BY) -> DataFrame:
    """Drops points that would need more than max_speed m/s from the last accepted one, or no time at all. The first stays.
    Other columns of the points stay; objects of which one point is left go. Each object's points are looked at once, in order, with the last accepted one kept."""

    return kernels.scan(points, by, lambda g: [kernels.within_speed(g, max_speed)], least=2)


# -- segmentation


def _islands(points: DataFrame, breaks: Column, by) -> DataFrame:
    marked = with_previous(points, by)
    seg = F.sum(F.when(breaks, 1).otherwise(0)).over(ordered(by).rowsBetween(Window.unboundedPreceding, 0))
    return at_least(marked.withColumn("segment", seg.cast("long")).drop("dt", "dist"), 2, (*by, "segment"))


def time_gap_segments(points: DataFrame, max_gap_s: float, by=BY) -> DataFrame:
    """A new segment after a gap of more than max_gap_s; segments of one point go."""
    return _islands(points, F.col("dt") > max_gap_s, by)


def distance_gap_segments(points: DataFrame, max_gap_m: float, by=BY) -> DataFrame:
    return _islands(points, F.col("dist") > max_gap_m, by)


def first_beyond(points: DataFrame, max_dist: float, max_stay_s: float, by=BY) -> DataFrame:
    """For each point: idx, next_idx (first farther than max_dist, or the number of points) and is_stay."""

    def run(group: kernels.Group) -> dict[str, np.ndarray]:
        n = len(group.micros)
        nxt = kernels.beyond(group, max_dist).astype(np.int32)
        return {"idx": np.arange(n, dtype=np.int32), "next_idx": nxt, "is_stay": group.micros[nxt - 1] - group.micros > max_stay_s * 1e6}

    return kernels.annotate(points, by, run, {"idx": "int", "next_idx": "int", "is_stay": "boolean"}).select(*by, "idx", "next_idx", "is_stay")


def _pieces(points: DataFrame, by, spans) -> DataFrame:
    """points with part and pos: those within the spans (first, end) that the kernel finds in each object, in order."""

    return kernels.scan(points, by, lambda g: [np.arange(lo, hi) for lo, hi in spans(g)], numbered=True)


def classic_stays(points: DataFrame, max_dist: float, max_stay_s: float, by=BY) -> DataFrame:
    """Greedy stays: points (part, pos) of each maximal run near its first point that lasts longer than max_stay_s."""
    return _pieces(points, by, lambda g: kernels.greedy_stays(g, max_dist, max_stay_s))


def stay_segments(points: DataFrame, max_dist: float, max_stay_s: float, by=BY) -> DataFrame:
    """What lies between greedy stays; pieces of three points or more. All columns of the points stay, so matched ones keep
    their candidates."""

    def between(group: kernels.Group):
        start = 0
        for lo, hi in [*kernels.greedy_stays(group, max_dist, max_stay_s), (len(group.micros), 0)]:
            if lo - start > 2:
                yield start, lo
            start = hi

    return _pieces(points, by, between)


def density_stays(points: DataFrame, max_dist: float, max_stay_s: float, by=BY) -> DataFrame:
    """Stays that grow while some member reaches further; one that reaches the last point is never closed."""
    return _pieces(points, by, lambda g: kernels.growing_stays(g, max_dist, max_stay_s))


def matched_segments(matched: DataFrame, max_gap_s: float = 300.0, max_dist: float = 50.0, max_stay_s: float = 180.0, by=BY) -> DataFrame:
    """Matched trajectories cut at time gaps, then at stays: segment, part and pos for each point left, with its candidate."""
    return stay_segments(time_gap_segments(matched, max_gap_s, by), max_dist, max_stay_s, (*by, "segment"))


def spaced_trajectories(points: DataFrame, max_gap_m: float, least_m: float, by=BY) -> DataFrame:
    """Trajectories cut at jumps of more than max_gap_m; only those longer than least_m in all."""
    cut = distance_gap_segments(points, max_gap_m, by)
    step = with_previous(cut, (*by, "segment"))
    return step.withColumn("dist", F.sum("dist").over(whole((*by, "segment")))).where(F.col("dist") > least_m).drop("dt", "dist")


def unmatched_runs(matched: DataFrame, tolerance: float, by=BY) -> DataFrame:
    """Maximal runs of points without a candidate or with an error beyond tolerance: run, prev_eid, next_eid for each point."""
    w = ordered(by)
    lost = F.col("eid").isNull() | (F.col("error") > tolerance)
    gone, ok = fresh(matched.columns, "lost", "ok")
    m = matched.withColumn(gone, lost).withColumn(ok, F.when(~lost, F.col("eid")))
    m = m.withColumns({
        "run": F.sum(F.when(F.col(gone), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "prev_eid": F.last(ok, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_eid": F.first(ok, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    return m.where(F.col(gone)).drop(gone, ok)


# -- measures


def measures(points: DataFrame, by=BY, radius: float = geo.EARTH_M) -> DataFrame:
    """n, start, end, duration_s, length_m, mean_dt, mean_dist, centroid and box of each group."""
    p = with_previous(points, by)
    return p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("start"), F.max("time").alias("end"), F.coalesce(F.sum("dist"), F.lit(0.0)).alias("length_m"), F.avg("dt").alias("mean_dt"), F.avg("dist").alias("mean_dist"),
        F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"), F.min("lat").alias("min_lat"), F.min("lng").alias("min_lng"), F.max("lat").alias("max_lat"), F.max("lng").alias("max_lng"),
    ).withColumn("duration_s", seconds_between(F.col("end"), F.col("start")))


def uniform_measures(points: DataFrame, by=BY) -> DataFrame:
    """n, length_m (radius 6371000 m), duration_s, and mean_dt and mean_dist as if points were evenly spread; two points at least."""
    p = with_previous(points, by)
    w = ordered(by)
    d = geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"), radius=geo.EARTH_CSV_M)
    m = p.withColumn("dist", d).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dist"), F.lit(0.0)).alias("length_m"), seconds_between(F.max("time"), F.min("time")).alias("duration_s")).where("n > 1")
    return m.withColumns({"mean_dt": F.col("duration_s") / (F.col("n") - 1), "mean_dist": F.col("length_m") / (F.col("n") - 1)})


def slice_time(points: DataFrame, start: str, end: str) -> DataFrame:
    return points.where((F.col("time") >= F.lit(start).cast("timestamp")) & (F.col("time") < F.lit(end).cast("timestamp")))


def position_at(points: DataFrame, asked: DataFrame, by=BY) -> DataFrame:
    """asked (by..., at): interpolated lat, lng; null before the first point and at or after the last.

    Union of both streams, ordered in time: each question sees the last point before and the first after it, so no range
    join is needed and each object is sorted once.
    """
    p = points.select(*by, "time", "seq", "lat", "lng", F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("kind"))
    q = asked.select(*by, F.col("at").alias("time"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), "at", F.lit(1).alias("kind"))
    here = F.when(F.col("kind") == 0, F.struct("time", "lat", "lng"))
    w = Window.partitionBy(*by).orderBy("time", "kind", "seq")
    both = p.unionByName(q).withColumns({"a": F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(here, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    rate = seconds_between(F.col("at"), F.col("a.time")) / seconds_between(F.col("b.time"), F.col("a.time"))
    lat, lng = geo.interpolate(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"), rate)
    return both.where("kind = 1").select(*by, "at", lat.alias("lat"), lng.alias("lng"))


def histogram(values: DataFrame, column: str, bins: int, share: bool = True) -> DataFrame:
    """bin, low, high, n or share of equal-width bins between the extremes; the last bin is closed."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    edges = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("total"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = v.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin"), "lo", "hi", "total").agg(F.count(F.lit(1)).alias("n"))
    amount = F.col("n") / F.col("total") if share else F.col("n")
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), amount.alias("share" if share else "n"))
