"""Time slots and temporal predicates as Column expressions. Times are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def daily_slot(time: Column, minutes: int, start: int = 0, end: int = 1440) -> Column:
    """Slot of the minute of the day; raises outside of [start, end)."""
    m = F.hour(time) * 60 + F.minute(time)
    return F.when((m >= start) & (m < end), F.floor((m - start) / minutes).cast("int")).otherwise(F.raise_error(F.lit("time outside of the daily index")).cast("int"))


def slot(time: Column, start: str, end: str, minutes: int) -> Column:
    """Absolute slot number; null outside of [start, end)."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return F.when((time >= s) & (time < e), F.floor((F.unix_micros(time) - F.unix_micros(s)) / (minutes * 60_000_000)).cast("int"))


def slot_range(first: Column, last: Column, start: str, end: str, minutes: int) -> Column:
    """All slots from that of first to that of last, both included; null if one of them is outside of [start, end)."""
    return F.sequence(slot(first, start, end, minutes), slot(last, start, end, minutes))


def slot_start(index: Column, start: str, minutes: int) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + index.cast("bigint") * (minutes * 60_000_000))


def slots(spark: SparkSession, start: str, end: str, minutes: int) -> DataFrame:
    """slot, start for all slots, with weekday (Monday 0), hour and whether it lies in the day [6, 18)."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    n = F.ceil((F.unix_micros(e) - F.unix_micros(s)) / (minutes * 60_000_000)).cast("int")
    t = spark.range(1).select(F.explode(F.sequence(F.lit(0), n - 1)).alias("slot")).withColumn("start", slot_start(F.col("slot"), start, minutes))
    return t.withColumns({"weekday": F.weekday("start"), "hour": F.hour("start")}).withColumns({"is_day": (F.col("hour") >= 6) & (F.col("hour") < 18), "is_weekend": F.col("weekday") >= 5})


def temporal_valid(first: Column, last: Column, start: Column, end: Column, relation: str = "middle") -> Column:
    """middle: half the way lies in the window; first: the first point does; intersect: the window meets [first, last + 1 s)."""
    if relation == "middle":
        mid = F.timestamp_micros(F.floor((F.unix_micros(first) + F.unix_micros(last)) / 2))
        return (mid >= start) & (mid < end)
    if relation == "first":
        return (first >= start) & (first < end)
    return (first < end) & (last + F.expr("interval 1 second") > start)
