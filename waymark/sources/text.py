"""Text formats of trajectories and paths: readers, writers and converters. Parquet is the canonical form.

A block text file holds many trajectories: a header line that starts with `#,`, then one line per point. Files are split at
the headers by the reader itself (lineSep), so that one record is one trajectory, large files are split over tasks, and the
order of lines needs no bookkeeping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

TIME, TIME_MS = "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSS"
MATCH = ("eid", "proj_lat", "proj_lng", "error", "offset")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    b = spark.read.text(path, lineSep="#,").where(F.length(F.trim("value")) > 0)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    return b.select(F.split(F.element_at(lines, 1), ",").alias("head"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("lines")).where(F.size("head") > 1)


def strict_bool(text: Column) -> Column:
    return F.when(text == "True", True).when(text == "False", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def read_trajectories(spark: SparkSession, path: str, matched: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """oid, tid, pos, time, lat, lng and either extra columns (strings, but stay a boolean) or the candidate (null for None)."""
    rows = _blocks(spark, path).select(F.col("head")[0].alias("tid"), F.col("head")[1].alias("oid"), F.posexplode("lines").alias("pos", "line"))
    c = F.split("line", ",")
    base = [F.col("oid"), F.col("tid"), F.col("pos"), F.to_timestamp(c[0], TIME).alias("time"), c[1].cast("double").alias("lat"), c[2].cast("double").alias("lng")]
    if matched:
        none = c[3] == "None"
        return rows.select(*base, *[F.when(~none, F.get(c, F.lit(3 + k))).cast("int" if k == 0 else "double").alias(n) for k, n in enumerate(MATCH)])
    value = lambda k, n: strict_bool(F.get(c, F.lit(3 + k))) if n == "stay" else F.get(c, F.lit(3 + k))
    return rows.select(*base, *[value(k, n).alias(n) for k, n in enumerate(extra)])


def _number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def trajectory_blocks(points: DataFrame, matched: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row of text per trajectory (oid, tid): header with start, end and kilometres, then its points."""
    tail = []
    if matched:
        texts = [F.col("eid").cast("string"), *[_number(F.col(n), 7) for n in ("proj_lat", "proj_lng")], *[_number(F.col(n), 2) for n in ("error", "offset")]]
        tail = [F.coalesce(t, F.lit("None")) for t in texts]
    elif extra:
        tail = [F.when(F.col(n), "True").otherwise("False") if n == "stay" else F.col(n).cast("string") for n in extra]
    line = F.concat_ws(",", F.date_format("time", TIME), _number(F.col("lat"), 7), _number(F.col("lng"), 7), *tail)
    g = points.withColumn("_line", line).groupBy("oid", "tid").agg(F.array_sort(F.collect_list(F.struct("time", "seq", "lat", "lng", "_line"))).alias("p"))
    km = geo.length_m(F.col("p")) / 1000
    head = F.concat_ws(",", F.lit("#"), "tid", F.col("oid").cast("string"), F.date_format(F.element_at("p", 1)["time"], TIME), F.date_format(F.element_at("p", -1)["time"], TIME), F.concat(_number(km, 4), F.lit(" km")))
    return g.select(F.concat_ws("\n", head, F.transform("p", lambda x: x["_line"])).alias("value"))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """pid, oid, pos, enter_time, leave_time, eid."""
    rows = _blocks(spark, path).select(F.col("head")[0].alias("pid"), F.col("head")[1].alias("oid"), F.posexplode("lines").alias("pos", "line"))
    c = F.split("line", ",")
    return rows.select("pid", "oid", "pos", F.to_timestamp(c[0], TIME_MS).alias("enter_time"), F.to_timestamp(c[1], TIME_MS).alias("leave_time"), c[2].cast("int").alias("eid"))


def path_blocks(paths: DataFrame) -> DataFrame:
    """One row of text per path (pid, oid)."""
    line = F.concat_ws(",", F.date_format("enter_time", TIME_MS), F.date_format("leave_time", TIME_MS), F.col("eid").cast("string"))
    g = paths.groupBy("pid", "oid").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), "enter_time", "leave_time"))).alias("p"))
    head = F.concat_ws(",", F.lit("#"), F.col("pid").cast("string"), F.col("oid").cast("string"), F.date_format(F.element_at("p", 1)["enter_time"], TIME_MS), F.date_format(F.element_at("p", -1)["leave_time"], TIME_MS))
    return g.select(F.concat_ws("\n", head, F.transform("p", lambda x: x["line"])).alias("value"))


def read_taxi_logs(spark: SparkSession, path: str, name: str = r"([^/]+?)(\.txt)?$") -> DataFrame:
    """oid (the part of the file's path that name finds, by default the file's name), time, lat, lng of comma-separated id, time, lng, lat; objects of one point go."""
    from pyspark.sql import Window

    raw = spark.read.csv(path, schema="id string, time timestamp, lng double, lat double", timestampFormat="yyyy-MM-dd HH:mm:ss")
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("oid"), "time", "lat", "lng")
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("oid"))).where("n > 1").drop("n")


def trajectories_to_wkt(points: DataFrame) -> DataFrame:
    """tid, oid, start_time, end_time, wkt of (oid, tid) groups of two points or more."""
    g = points.groupBy("tid", "oid").agg(F.array_sort(F.collect_list(F.struct("time", "seq", "lat", "lng"))).alias("p")).where(F.size("p") > 1)
    return g.select("tid", "oid", F.element_at("p", 1)["time"].alias("start_time"), F.element_at("p", -1)["time"].alias("end_time"), geo.wkt_line(F.col("p")).alias("wkt"))


def read_wkt_csv(spark: SparkSession, path: str) -> DataFrame:
    """tid, oid, start_time, end_time, pts: rows with an unparsable time or line, or fewer than two vertices, are skipped."""
    raw = spark.read.csv(path, header=True, schema="tid string, oid string, start_time string, end_time string, wkt string")
    rows = raw.select("tid", "oid", *[F.try_to_timestamp(c).alias(c) for c in ("start_time", "end_time")], geo.parse_wkt_line(F.col("wkt")).alias("pts"))
    return rows.where("start_time is not null and end_time is not null and pts is not null and size(pts) > 1")


def paths_to_wkt(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """pid, n_edges, wkt: geometries in path order, without the vertex that two neighbours share; unknown edges are left out."""
    known = paths.join(edges.select("eid", "coords"), "eid")
    g = known.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "coords"))).alias("p"))
    same = lambda a, b: (a["lat"] == b["lat"]) & (a["lng"] == b["lng"])

    def add(acc, x):
        c = x["coords"]
        rest = F.when((F.size(acc) > 0) & same(F.try_element_at(acc, F.lit(-1)), F.element_at(c, 1)), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)
        return F.concat(acc, rest)

    line = F.aggregate("p", F.array().cast("array<struct<lat:double,lng:double>>"), add)
    return g.select("pid", F.size("p").alias("n_edges"), line.alias("line")).where(F.size("line") > 1).select("pid", "n_edges", geo.wkt_line(F.col("line")).alias("wkt"))


def parse_model_log(lines: DataFrame, order: str = "pos", text: str = "value") -> DataFrame:
    """epoch, phase, loss, p, r, f1, iou of a training log: an epoch line opens an epoch, `Val Loss` its second phase."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    num = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("double")
    e = lines.withColumn("epoch", F.last(F.regexp_extract(text, r"=+ Epoch (\d+)", 1).try_cast("int"), ignorenulls=True).over(w))
    e = e.withColumn("is_val", F.col(text).contains("Val Loss"))
    e = e.withColumn("phase", F.when(F.max(F.col("is_val").cast("int")).over(Window.partitionBy("run", "epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) == 1, "val").otherwise("train"))
    return e.groupBy("run", "epoch", "phase").agg(*[F.max(num(rf"{k}:\s*([-0-9.]+)")).alias(n) for k, n in (("Loss", "loss"), ("P", "p"), ("R", "r"), ("F1", "f1"), ("IOU", "iou"))])
