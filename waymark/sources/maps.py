"""Road networks, map extracts, boxes, split indices and result files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.numbering import numbered

#: Ways that are no roads for cars (fixed values).
NO_ROADS = ("footway", "path", "service", "parking", "driveway", "cycleway", "steps", "bridleway")


def roads_and_buildings(ways: DataFrame, refs: DataFrame) -> DataFrame:
    """way, kind (road or building), n: ways (way, highway, building) with enough nodes in refs (way, pos, node)."""
    n = refs.groupBy("way").agg(F.count(F.lit(1)).alias("n"))
    w = ways.join(n, "way")
    roads = w.where(F.col("highway").isNotNull() & ~F.col("highway").isin(*NO_ROADS) & (F.col("n") >= 2)).select("way", F.lit("road").alias("kind"), "n")
    return roads.unionByName(w.where(F.col("building").isNotNull() & (F.col("n") >= 3)).select("way", F.lit("building").alias("kind"), "n"))


#: What an extract's elements hold: identifiers, places, references in order, tags.
NODE = "_id long, _lat double, _lon double"
WAY = "_id long, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>"


def write_extract(nodes: DataFrame, ways: DataFrame, refs: DataFrame, path: str) -> None:
    """A map extract in XML: nodes (node, lat, lng) and ways (way, highway, building) with their refs (way, pos, node) in order.
    Nodes without a place and tags without a value are not written."""
    placed = nodes.where("node IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")
    placed.select(F.col("node").alias("_id"), F.col("lat").alias("_lat"), F.col("lng").alias("_lon")).write.xml(f"{path}/nodes", rowTag="node", rootTag="osm")
    nd = refs.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: F.struct(x["node"].alias("_ref"))).alias("nd"))
    tag = F.filter(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(k).alias("_v")) for k in ("highway", "building")]), lambda t: t["_v"].isNotNull())
    ways.join(nd, "way", "left").select(F.col("way").alias("_id"), "nd", tag.alias("tag")).write.xml(f"{path}/ways", rowTag="way", rootTag="osm")


def read_extract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (node, lat, lng), ways (way, highway, building) and refs (way, pos, node) of the map extracts in XML at or below path.

    Elements are found by their tag in splits of the files, so one large extract is read by many tasks. Elements without an
    identifier are skipped; of a tag given twice the last value stays.
    """
    read = lambda tag, schema: spark.read.schema(schema).option("recursiveFileLookup", True).xml(path, rowTag=tag).where("_id IS NOT NULL")
    nodes = read("node", NODE).select(F.col("_id").alias("node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lng"))
    raw = read("way", WAY)
    value = lambda k: F.try_element_at(F.filter("tag", lambda t: t["_k"] == k), F.lit(-1))["_v"].alias(k)
    ways = raw.select(F.col("_id").alias("way"), value("highway"), value("building"))
    refs = raw.select(F.col("_id").alias("way"), F.posexplode("nd").alias("pos", "nd")).select("way", "pos", F.col("nd._ref").alias("node"))
    return nodes, ways, refs


def placed_ways(nodes: DataFrame, ways: DataFrame, refs: DataFrame) -> DataFrame:
    """way, kind, n, coords: roads and buildings as lists of struct(lat, lng) in the order of their references. As documented, a
    way with any reference to a node that is missing or has no place is left out. Of a node told twice the largest place counts.

    Only references of ways that are kept meet the nodes, and a node meets each of its references once.
    """
    kept = roads_and_buildings(ways, refs)
    at = nodes.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy("node").agg(F.max(F.struct("lat", "lng")).alias("at"))
    used = refs.join(kept.select("way").distinct(), "way", "left_semi").join(at, "node")
    lines = used.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("_points"))
    coords = F.transform("_points", lambda x: x["at"]).alias("coords")
    return kept.join(lines, "way").where(F.size("_points") == F.col("n")).select("way", "kind", "n", coords)


def write_network(edges: DataFrame, path: str) -> None:
    """eid, length, wkt as CSV."""
    edges.select("eid", "length", geo.wkt_line(F.col("coords")).alias("wkt")).write.csv(path, header=True)


def read_network(spark: SparkSession, path: str, keep_eid: bool = False) -> DataFrame:
    """eid, coords, length of lines with two vertices or more. Edges are numbered anew by their stored number unless it is kept;
    of edges with the same ends the last stays."""
    raw = spark.read.csv(path, header=True, schema="eid long, length double, wkt string")
    e = raw.select("eid", geo.parse_wkt_line(F.col("wkt")).alias("coords")).where("size(coords) > 1")
    if not keep_eid:
        e = numbered(e.withColumnRenamed("eid", "stored"), [F.col("stored")], "eid").drop("stored").select("eid", "coords")
    ends = [F.element_at("coords", 1), F.element_at("coords", -1)]
    last = F.max("eid").over(Window.partitionBy(*ends))
    return e.withColumn("_last", last).where("eid = _last").drop("_last").withColumn("length", geo.length_m(F.col("coords")))


def write_boxes(boxes: DataFrame, path: str) -> None:
    """name;min_lat;min_lng;max_lat;max_lng;wkt."""
    c = ("min_lat", "min_lng", "max_lat", "max_lng")
    boxes.select("name", *c, geo.wkt_box(*[F.col(x) for x in c]).alias("wkt")).write.csv(path, header=True, sep=";")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep=";", schema="name string, min_lat double, min_lng double, max_lat double, max_lng double, wkt string")


def split_lists(splits: DataFrame, column: str) -> DataFrame:
    """split, indices (sorted): the three lists of a split file."""
    return splits.groupBy("split").agg(F.array_sort(F.collect_list(column)).alias("indices"))


def read_scores(lines: DataFrame) -> DataFrame:
    """region, value of APLS result lines (last token of the line; NaN is null) and precision, recall of TOPO summaries."""
    last = F.regexp_extract("value", r"(\S+)\s*$", 1).try_cast("double")
    num = lambda k: F.regexp_extract("value", rf"{k}=\s*([-0-9.eE]+)", 1).try_cast("double")
    return lines.select("region", F.when(~F.isnan(last), last).alias("value"), num("precision").alias("precision"), num("overall-recall").alias("recall"))


def summary_json(scores: DataFrame, metric: str) -> DataFrame:
    """One JSON text: mean of the values that are there, and how many regions were evaluated, skipped and in all."""
    s = scores.agg(F.round(F.avg(metric), 9).alias("mean"), F.count(metric).alias("evaluated"), F.sum(F.col(metric).isNull().cast("long")).alias("skipped"), F.count(F.lit(1)).alias("total"))
    return s.select(F.to_json(F.struct("mean", "evaluated", "skipped", "total")).alias("json"))
