"""Streaming twins of the batch operators (an extension: the batch operators are what parity asks for)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(points: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """oid, start, end, n: session windows; a point exactly gap later still belongs to its session."""
    w = F.session_window("time", gap)
    s = points.withWatermark("time", late).groupBy("oid", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("start"), F.max("time").alias("end"))
    return s.select("oid", "start", "end", "n")


def speed_filter(points: DataFrame, max_speed: float) -> DataFrame:
    """The speed filter with the last accepted point of each object as state. Points are expected in order of time per batch."""
    out = "oid long, seq long, time timestamp, lat double, lng double"

    def run(key, batches, state: GroupState):
        last = state.get if state.exists else None
        rows = []
        for pdf in batches:
            for r in pdf.sort_values(["time", "seq"]).itertuples(index=False):
                now = r.time.timestamp()
                if last is not None:
                    a, b = math.radians(last[1]), math.radians(r.lat)
                    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(r.lng - last[2]) / 2) ** 2
                    if now <= last[0] or 2 * 6371008.7714 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) > max_speed * (now - last[0]):
                        continue
                last = (now, r.lat, r.lng)
                rows.append((r.oid, r.seq, r.time, r.lat, r.lng))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=["oid", "seq", "time", "lat", "lng"])

    return points.select("oid", "seq", "time", "lat", "lng").groupBy("oid").applyInPandasWithState(run, out, "time double, lat double, lng double", "append", GroupStateTimeout.NoTimeout)
