"""Queries on map sources, files of results, windows and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, temporal
from ..operators import raster, spatial
from ..operators import trajectory as T
from ..operators.numbering import numbered
from ..sources import fixtures as X
from ..sources import maps, text
from ..sources.scratch import scratch_path
from . import sql as S
from .map_queries import CANDIDATES
from .network_queries import TRAILS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


@query("""WITH n AS (SELECT l_orderkey AS way, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT o_orderkey AS way, CASE o_orderpriority WHEN '1-URGENT' THEN 'footway' WHEN '2-HIGH' THEN 'residential' WHEN '3-MEDIUM' THEN 'service' WHEN '5-LOW' THEN 'primary' END AS highway, CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS building FROM orders)
SELECT way, 'road' AS kind, n FROM w JOIN n USING (way) WHERE highway NOT IN ('footway', 'service') AND n >= 2 UNION ALL SELECT way, 'building', n FROM w JOIN n USING (way) WHERE building IS NOT NULL AND n >= 3""")
def src_map_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tagged ways, their lines as node references."""
    return maps.roads_and_buildings(_ways(spark, sf_dir), X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way")))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    kinds = {"1-URGENT": "footway", "2-HIGH": "residential", "3-MEDIUM": "service", "5-LOW": "primary"}
    highway = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in kinds.items()])
    return o.select(F.col("o_orderkey").alias("way"), highway.alias("highway"), F.when(F.col("o_orderstatus") == "F", "yes").alias("building"))


@query(f"""WITH node AS (
    SELECT p_partkey AS node, 34.0 + p_partkey * 7919 % 10007 / 100000.0 AS lat, 108.0 + p_partkey * 104729 % 10009 / 100000.0 AS lng
    FROM part WHERE p_size > 5),
refs AS (SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem),
n AS (SELECT way, count(*) AS n FROM refs GROUP BY way),
w AS (
    SELECT o_orderkey AS way, o_orderstatus = 'F' AS building,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'footway' WHEN '2-HIGH' THEN 'residential' WHEN '3-MEDIUM' THEN 'service' WHEN '5-LOW' THEN 'primary' END AS highway
    FROM orders),
kept AS (
    SELECT way, 'road' AS kind, n FROM w JOIN n USING (way) WHERE highway NOT IN ('footway', 'service') AND n >= 2
    UNION ALL SELECT way, 'building', n FROM w JOIN n USING (way) WHERE building AND n >= 3),
hops AS (
    SELECT way, pos, lat, lng, lag(lat) OVER s AS lat0, lag(lng) OVER s AS lng0 FROM refs JOIN node USING (node) WINDOW s AS (PARTITION BY way ORDER BY pos)),
lines AS (
    SELECT way, count(*) AS placed, arg_min(lat, pos) AS lat, arg_max(lng, pos) AS lng, coalesce(sum({S.hav('lat0', 'lng0', 'lat', 'lng')}) FILTER (lat0 IS NOT NULL), 0) AS length
    FROM hops GROUP BY way)
SELECT way, kind, n, round(lat, 6) AS start_lat, round(lng, 6) AS end_lng, round(length, 1) AS length FROM kept JOIN lines USING (way) WHERE placed = n""")
def src_map_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes (small ones have no place), orders as ways, written as an extract, read back and placed."""
    path = scratch_path(spark, "extract")
    key = F.col("p_partkey")
    at = lambda base, step, most: F.when(F.col("p_size") > 5, base + key * step % most / F.lit(100000.0))
    nodes = X.table(spark, sf_dir, "part").select(key.alias("node"), at(34.0, 7919, 10007).alias("lat"), at(108.0, 104729, 10009).alias("lng"))
    refs = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("node"))
    maps.write_extract(nodes, _ways(spark, sf_dir), refs, path)
    ways = maps.placed_ways(*maps.read_extract(spark, path))
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    return ways.select("way", "kind", "n", r(first["lat"]).alias("start_lat"), r(last["lng"]).alias("end_lng"), r(geo.length_m(F.col("coords")), 1).alias("length"))


@query(f"WITH {TRAILS}, k AS (SELECT region * 1000 + eid AS id, y1, x1, y2, x2 FROM te), m AS (SELECT max(id) AS id, y1, x1, y2, x2 FROM k GROUP BY round(y1, 7), round(x1, 7), round(y2, 7), round(x2, 7), y1, x1, y2, x2), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS eid FROM k) SELECT n.eid::BIGINT AS eid, round(y1, 6) AS lat, round({S.hav('y1', 'x1', 'y2', 'x2')}, 1) AS length FROM m JOIN n USING (id)")
def src_network_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions' edges written as lines, read back and numbered anew; of equal ends the last stays."""
    path = scratch_path(spark, "network")
    maps.write_network(X.trail_edges(spark, sf_dir).withColumn("eid", F.col("region") * 1000 + F.col("eid")), path)
    return maps.read_network(spark, path).select("eid", r(F.element_at("coords", 1)["lat"], 6).alias("lat"), r("length", 1).alias("length"))


@query(f"WITH {S.GPS} SELECT oid::VARCHAR AS name, min(lat) AS min_lat, max(lng) AS max_lng FROM gps GROUP BY oid")
def src_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "boxes")
    b = X.gps(spark, sf_dir).groupBy(F.col("oid").cast("string").alias("name")).agg(F.min("lat").alias("min_lat"), F.min("lng").alias("min_lng"), F.max("lat").alias("max_lat"), F.max("lng").alias("max_lng"))
    maps.write_boxes(b, path)
    return maps.read_boxes(spark, path).select("name", "min_lat", "max_lng")


@query(f"""WITH {CANDIDATES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY oid, seq ORDER BY round(error, 6), eid) AS k FROM cand) WHERE k = 1), m AS (SELECT oid, time, py, count(*) OVER (PARTITION BY oid) AS n FROM best)
SELECT oid, count(*) AS n, date_trunc('second', min(time)) AS start_time, round(sum(round(py, 7)), 5) AS lat FROM m WHERE n > 1 GROUP BY oid""")
def snk_matched_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the nearest candidates as WKT in CSV files of ten groups, merged again; points without any are left out."""
    path = scratch_path(spark, "matched-wkt")
    c = spatial.candidates(X.gps(spark, sf_dir), X.lattice_edges(spark), 50.0)
    best = c.groupBy("oid", "seq").agg(F.min_by(F.struct("time", "proj_lat", "proj_lng"), F.struct(F.round("error", 6), "eid")).alias("b"))
    p = best.select("oid", "seq", "b.time", F.col("b.proj_lat").alias("lat"), F.col("b.proj_lng").alias("lng"), F.col("oid").cast("string").alias("tid"))
    out = text.trajectories_to_wkt(p)
    out = out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_time", "end_time")}).withColumn("part", F.col("oid") % 10)
    out.write.partitionBy("part").csv(path, header=True)
    merged = text.read_wkt_csv(spark, f"{path}/*/*.csv")
    lat = F.aggregate("pts", F.lit(0.0), lambda s, x: s + x["lat"])
    return merged.select(F.col("oid").cast("long").alias("oid"), F.size("pts").cast("long").alias("n"), "start_time", r(lat, 5).alias("lat"))


@query("SELECT split, array_to_string(list(vec_id ORDER BY vec_id), ' ') AS indices FROM (SELECT vec_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT vec_id, ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM embeddings)) GROUP BY split")
def snk_split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split lists written as JSON and read back: a split's list is its index file."""
    path = scratch_path(spark, "splits")
    maps.split_lists(raster.split_by_hash(X.patches(spark, sf_dir), "vec_id"), "vec_id").write.json(path)
    return spark.read.schema("split string, indices array<long>").json(path).select("split", F.array_join("indices", " ").alias("indices"))


@query(f"WITH {TRAILS}, g AS (SELECT region, CASE WHEN region % 9 > 0 THEN round(sum(CASE WHEN eid % 10 >= 3 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) END AS v FROM te GROUP BY region) SELECT round(avg(v), 6) AS mean, count(v) AS evaluated, count(*) - count(v) AS skipped FROM g")
def agg_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines of each region (some NaN) read back and averaged over those that have a value."""
    e = X.trail_edges(spark, sf_dir).groupBy("region").agg(F.round(F.avg((F.col("eid") % 10 >= 3).cast("double")), 6).alias("v"))
    lines = e.select("region", F.concat(F.lit("0.1 0.2 "), F.when(F.col("region") % 9 > 0, F.format_string("%.6f", "v")).otherwise("NaN")).alias("value"))
    j = maps.summary_json(maps.read_scores(lines), "value")
    parsed = F.from_json("json", "mean double, evaluated long, skipped long")
    return j.select(parsed.alias("p")).select(r("p.mean").alias("mean"), "p.evaluated", "p.skipped")


@query(f"WITH {TRAILS} SELECT region, eid, 0 AS pos, TIMESTAMP '2019-01-01' + to_seconds(eid * 2) AS time, round(y1, 7) AS lat FROM te UNION ALL SELECT region, eid, 1, TIMESTAMP '2019-01-01' + to_seconds(eid * 2 + 1), round(y2, 7) FROM te")
def net_pseudo_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge as a trajectory of two points, a second apart."""
    e = X.trail_edges(spark, sf_dir).select("region", "eid", F.posexplode("coords").alias("pos", "p"))
    return e.select("region", "eid", "pos", F.timestamp_seconds(F.unix_seconds(F.lit("2019-01-01").cast("timestamp")) + F.col("eid") * 2 + F.col("pos")).alias("time"), r("p.lat", 7).alias("lat"))


@query(f"WITH {S.GPS}, d AS (SELECT oid, min(time) AS a, max(time) AS z FROM gps GROUP BY oid) SELECT oid, a AS start, z AS \"end\" FROM d")
def trj_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories are the same if object, start and end are: a doubled corpus has each once."""
    m = T.measures(X.gps(spark, sf_dir)).select("oid", "start", "end")
    return m.unionByName(m).dropDuplicates(["oid", "start", "end"])


@query(f"""WITH {S.GPS}, d AS (SELECT oid, min(time) AS a, max(time) AS z FROM gps GROUP BY oid)
SELECT oid, a >= TIMESTAMP '2024-01-01 12:00:00' AND a < TIMESTAMP '2024-01-02' AS first_in, a < TIMESTAMP '2024-01-02' AND z + INTERVAL 1 SECOND > TIMESTAMP '2024-01-01 12:00:00' AS meets FROM d""")
def tim_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.gps(spark, sf_dir).groupBy("oid").agg(F.min("time").alias("a"), F.max("time").alias("z"))
    window = [F.lit(x).cast("timestamp") for x in ("2024-01-01 12:00:00", "2024-01-02")]
    valid = lambda how: temporal.temporal_valid(F.col("a"), F.col("z"), *window, how)
    return d.select("oid", valid("first").alias("first_in"), valid("intersect").alias("meets"))


@query("SELECT vec_id, (vec_id % 44 * 128)::INT AS x, (vec_id // 44 * 128)::INT AS y FROM embeddings")
def idx_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = raster.window_place(F.col("vec_id"), 5625, 128)
    return X.table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), y.alias("y"))


@query("WITH f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS position FROM embeddings), s AS (SELECT vec_id AS idx, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT vec_id, ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM embeddings)) SELECT split, position, vec_id FROM s JOIN f ON position = idx")
def src_patch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of a split file are positions in the list of patch files, sorted as text."""
    p = X.patches(spark, sf_dir).select("vec_id")
    files = numbered(p, [F.col("vec_id").cast("string")], "position")
    return files.join(raster.split_by_hash(p.withColumnRenamed("vec_id", "position"), "position"), "position").select("split", "position", "vec_id")


CANVAS = "px AS (SELECT vec_id, (4 * (vec_id // 25) + k // 8)::INT AS y, (4 * (vec_id % 25) + k % 8)::INT AS x, CASE WHEN embedding[k + 1] > 0 THEN 1 ELSE 0 END AS v FROM (SELECT vec_id, embedding, unnest(generate_series(0, 63)) AS k FROM embeddings)), canvas AS (SELECT DISTINCT y, x FROM px WHERE v = 1)"


@query(f"WITH {CANVAS}, w AS (SELECT vec_id AS idx, (vec_id % 7 * 16)::INT AS wx, (vec_id // 7 * 16)::INT AS wy FROM embeddings) SELECT idx, y - wy AS dy, x - wx AS dx FROM w JOIN canvas ON y >= wy AND y < wy + 32 AND x >= wx AND x < wx + 32")
def ras_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of 32 pixels every 16 over the stitched canvas; beyond its edge they are empty."""
    p = X.patches(spark, sf_dir)
    x, y = raster.window_place(F.col("vec_id"), 7 * 16, 16)
    windows = p.select(F.col("vec_id").alias("idx"), x.alias("wx"), y.alias("wy"))
    return raster.crop(raster.stitch(raster.to_pixels(p, 8)), windows, 32, 16).select("idx", "dy", "dx")


@query("WITH s AS (SELECT vec_id AS region, CASE WHEN label % 10 = 0 THEN 'val' WHEN label % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM embeddings) SELECT region * 4 + k AS patch, region, split, false AS leaked FROM s, (VALUES (0), (1), (2), (3)) t(k)")
def ras_region_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four patches for each region; none may lie in another split than its region."""
    split = F.when(F.col("label") % 10 == 0, "val").when(F.col("label") % 10 == 1, "test").otherwise("train")
    patches = raster.region_patches(X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("region"), split.alias("split")))
    leaks = raster.leaked_regions(patches).withColumn("leaked", F.lit(True))
    return patches.join(leaks, "region", "left").select("patch", "region", "split", F.coalesce("leaked", F.lit(False)).alias("leaked"))


@query(f"""WITH {TRAILS}, p AS (SELECT region AS tile, floor((y1 - 34.2) / 0.0004)::INT AS a, floor((x1 - 108.9) / 0.0004)::INT AS b, floor((y2 - 34.2) / 0.0004)::INT AS c, floor((x2 - 108.9) / 0.0004)::INT AS d FROM te),
n AS (SELECT *, greatest(abs(c - a), abs(d - b), 1) AS n FROM p), k AS (SELECT *, unnest(generate_series(0, n)) AS k FROM n) SELECT DISTINCT tile, floor(a + (c - a) * k / n + 0.5)::INT AS y, floor(b + (d - b) * k / n + 0.5)::INT AS x FROM k""")
def ras_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges drawn as pixels of 0.0004 degrees."""
    e, at = X.trail_edges(spark, sf_dir), lambda i, c, o: F.floor((F.element_at("coords", i)[c] - o) / 0.0004).cast("int")
    lines = e.select(F.col("region").alias("tile"), at(1, "lat", 34.2).alias("y1"), at(1, "lng", 108.9).alias("x1"), at(-1, "lat", 34.2).alias("y2"), at(-1, "lng", 108.9).alias("x2"))
    return raster.lines_to_pixels(lines)


@query("WITH s AS (SELECT label AS run, (row_number() OVER (PARTITION BY label ORDER BY vec_id))::INT AS epoch, round(embedding[1]::DOUBLE, 4) AS a, round(embedding[2]::DOUBLE, 4) AS b, round(embedding[3]::DOUBLE, 4) AS c FROM embeddings) SELECT run, epoch, 'train' AS phase, a AS loss, NULL::DOUBLE AS f1 FROM s UNION ALL SELECT run, epoch, 'val', b, c FROM s")
def src_model_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training logs made of the vectors, parsed back: an epoch line, a loss, then validation loss and scores."""
    from pyspark.sql import Window

    e = X.table(spark, sf_dir, "embeddings").withColumn("epoch", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    num = lambda i: F.format_string("%.4f", F.round(F.element_at("embedding", i).cast("double"), 4))
    lines = F.array(F.concat(F.lit("===== Epoch "), F.col("epoch").cast("string"), F.lit(" =====")), F.concat(F.lit("Loss: "), num(1)), F.concat(F.lit("Val Loss: "), num(2)), F.concat(F.lit("P: 0.5 R: 0.5 F1: "), num(3), F.lit(" IOU: 0.5")))
    log = e.select(F.col("label").alias("run"), F.posexplode(lines).alias("k", "value"), "epoch").select("run", (F.col("epoch") * 10 + F.col("k")).alias("pos"), "value")
    return text.parse_model_log(log).select("run", "epoch", "phase", "loss", "f1")


@query(f"WITH {S.GPS}, a AS (SELECT oid, seq, round((34.279658::DOUBLE - lat) / (34.279658::DOUBLE - 34.206385::DOUBLE) * 400, 3) AS row, round((lng - 108.917423::DOUBLE) / (108.99286::DOUBLE - 108.917423::DOUBLE) * 400, 3) AS col FROM gps) SELECT oid, count(DISTINCT row::VARCHAR || ' ' || col::VARCHAR) AS n_nodes FROM a GROUP BY oid")
def snk_pixel_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as nodes of a 400-pixel tile, to a thousandth of a pixel: equal ones are one node."""
    b = F.struct(F.lit(X.BOX[0]).alias("min_lat"), F.lit(X.BOX[2]).alias("max_lat"), F.lit(X.BOX[1]).alias("min_lng"), F.lit(X.BOX[3]).alias("max_lng"))
    row, col = geo.geo_to_rc(F.col("lat"), F.col("lng"), b, 400)
    return X.gps(spark, sf_dir).groupBy("oid").agg(F.countDistinct(F.round(row, 3), F.round(col, 3)).alias("n_nodes"))
