"""Trajectories, road networks, paths and patches derived from the given tables (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = (34.206385, 108.917423, 34.279658, 108.99286)
KINDS = {"click": 0, "view": 1, "purchase": 2, "signup": 3}
ROWS, COLS, STEP = 58, 50, 0.0012


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """oid, seq, time, lat, lng: one point per event."""
    e, d = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), lambda x: F.lit(float(x))
    kind = F.lit(4)
    for k, v in reversed(KINDS.items()):
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    u, n = F.col("user_id"), F.col("event_id")
    lat = d(BOX[0]) + (u * 37 % 50).cast("double") * d(STEP) + kind.cast("double") * d(0.002) + (n * 7919 % 101).cast("double") * d(0.000004) + F.when(n % 41 == 0, 0.2).otherwise(0.0)
    lng = d(BOX[1]) + (u * 53 % 50).cast("double") * d(STEP) + (n * 104729 % 101).cast("double") * d(0.000004)
    return e.select(u.alias("oid"), n.alias("seq"), F.col("ts").cast("timestamp").alias("time"), lat.alias("lat"), lng.alias("lng"))


def lattice_nodes(spark: SparkSession) -> DataFrame:
    n = spark.range(ROWS * COLS).withColumnRenamed("id", "node_id")
    i, j = F.floor(F.col("node_id") / COLS), F.col("node_id") % COLS
    return n.select("node_id", (F.lit(BOX[0]) + F.lit(STEP) * i.cast("double")).alias("lat"), (F.lit(BOX[1]) + F.lit(STEP) * j.cast("double")).alias("lng"))


def lattice_edges(spark: SparkSession) -> DataFrame:
    """eid, u, v, coords, length: the undirected lattice; every third edge has a vertex in its middle."""
    from ..functions import geo

    n = lattice_nodes(spark)
    id_ = F.col("node_id")
    ends = n.select(id_.alias("u"), F.explode(F.array_compact(F.array(F.when(id_ % COLS < COLS - 1, id_ + 1), F.when(id_ < (ROWS - 1) * COLS, id_ + COLS)))).alias("v"))
    # The number of an edge follows from its ends: two for each node before it in the row, one in the last column and row.
    row, col = F.floor(F.col("u") / COLS), F.col("u") % COLS
    before = row * (2 * COLS - 1) + F.when(row < ROWS - 1, col * 2).otherwise(col)
    ends = ends.withColumn("eid", (before + F.when((F.col("v") == F.col("u") + COLS) & (col < COLS - 1), 1).otherwise(0)).cast("long"))
    at = lambda k: n.select(id_.alias(k), F.struct("lat", "lng").alias(f"p{k}"))
    p, q = F.col("pu"), F.col("pv")
    mid = F.struct(((p["lat"] + q["lat"]) / 2).alias("lat"), ((p["lng"] + q["lng"]) / 2).alias("lng"))
    coords = F.when(F.col("eid") % 3 == 0, F.array(p, mid, q)).otherwise(F.array(p, q))
    return ends.join(at("u"), "u").join(at("v"), "v").select("eid", "u", "v", coords.alias("coords")).withColumn("length", geo.length_m(F.col("coords")))


def partial_edges(spark: SparkSession) -> DataFrame:
    return lattice_edges(spark).where(F.col("eid") * 7919 % 10 >= 3)


def inferred_edges(spark: SparkSession) -> DataFrame:
    up = lambda p: F.struct((p["lat"] + 0.00002).alias("lat"), p["lng"].alias("lng"))
    return lattice_edges(spark).withColumn("coords", F.transform("coords", up))


def adjacency(spark: SparkSession) -> DataFrame:
    """region, eid, r1, c1, r2, c2, in_pred: edges that lie inside one region of 10 by 10 nodes."""
    e = lattice_edges(spark).select("eid", "u", "v")
    part = lambda x: (F.floor(F.floor(F.col(x) / COLS) / 10) * 5 + F.floor(F.col(x) % COLS / 10)).cast("long")
    r, c = lambda x: (F.lit(9) - F.floor(F.col(x) / COLS) % 10) * 40, lambda x: F.col(x) % COLS % 10 * 40
    return e.where(part("u") == part("v")).select(part("u").alias("region"), "eid", r("u").alias("r1"), c("u").alias("c1"), r("v").alias("r2"), c("v").alias("c2"), (F.col("eid") * 7919 % 10 >= 3).alias("in_pred"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, pos, eid, enter_time, leave_time: an order's lines as a path."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")) - 1
    li = li.select(F.col("l_orderkey").alias("pid"), pos.cast("int").alias("pos"), (F.col("l_partkey") % 5692).alias("eid"), F.col("l_shipdate").cast("timestamp").alias("ship"))
    enter = F.col("ship") + F.make_dt_interval(mins=F.col("pos"))
    return li.select("pid", "pos", "eid", enter.alias("enter_time"), (enter + F.expr("interval 1 minute")).alias("leave_time"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y, x (place on the canvas), data (64 values, row by row), pixels (0 or 1)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select(
        "vec_id", (4 * F.floor(F.col("vec_id") / 25)).cast("int").alias("y"), (4 * (F.col("vec_id") % 25)).cast("int").alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("data"), F.transform("embedding", lambda v: (v > 0).cast("int")).alias("pixels")
    )


CELL = 0.0004


def trail_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region (an object), eid, u, v, coords, length: the cells that an object visits as nodes, its moves as edges."""
    from pyspark.sql import Window

    from ..functions import geo
    from ..operators.network import numbered

    cell = (F.floor((F.col("lat") - 34.2) / CELL) * 100000 + F.floor((F.col("lng") - 108.9) / CELL)).cast("long")
    p = gps(spark, sf_dir).select(F.col("oid").alias("region"), "time", "seq", cell.alias("v"))
    moves = p.withColumn("u", F.lag("v").over(Window.partitionBy("region").orderBy("time", "seq"))).where("u is not null and u <> v")
    e = moves.select("region", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a, b = cell_centre(F.col("u")), cell_centre(F.col("v"))
    return numbered(e).select("region", "eid", "u", "v", F.array(a, b).alias("coords"), geo.haversine_m(a["lat"], a["lng"], b["lat"], b["lng"]).alias("length"))


def cell_centre(node):
    row, col = F.floor(node / 100000).cast("double"), (node % 100000).cast("double")
    return F.struct((F.lit(34.2) + (row + 0.5) * CELL).alias("lat"), (F.lit(108.9) + (col + 0.5) * CELL).alias("lng"))


def trail_nodes(edges: DataFrame) -> DataFrame:
    n = edges.select("region", F.col("u").alias("node")).union(edges.select("region", "v")).distinct()
    c = cell_centre(F.col("node"))
    return n.select("region", "node", c["lat"].alias("lat"), c["lng"].alias("lng"))
