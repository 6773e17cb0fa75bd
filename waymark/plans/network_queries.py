"""Queries on text formats and on the road networks that objects' moves make, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import network as N
from ..operators import trajectory as T
from ..sources import fixtures as X
from ..sources import text
from ..sources.scratch import scratch_path
from . import sql as S

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


def _trips(spark, sf_dir) -> DataFrame:
    w = T.whole()
    return X.gps(spark, sf_dir).withColumn("tid", T.trajectory_id(F.col("oid"), F.min("time").over(w), F.max("time").over(w)))


def _through_text(blocks: DataFrame, name: str) -> str:
    path = scratch_path(blocks.sparkSession, name)
    blocks.write.text(path)
    return path


TRIPS = f"{S.GPS}, trips AS (SELECT *, oid::VARCHAR || '_' || strftime(min(time) OVER w, '%Y%m%d%H%M%S') || '_' || strftime(max(time) OVER w, '%Y%m%d%H%M%S') AS tid, (row_number() OVER (PARTITION BY oid ORDER BY time, seq) - 1)::INT AS pos FROM gps WINDOW w AS (PARTITION BY oid))"


@query(f"WITH {TRIPS} SELECT oid::VARCHAR AS oid, tid, pos, date_trunc('second', time) AS time, round(lat, 7) AS lat, round(lng, 7) AS lng, seq % 2 = 0 AS stay FROM trips")
def src_trajectory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as block text with a stay column, read back."""
    p = _trips(spark, sf_dir).withColumn("stay", F.col("seq") % 2 == 0)
    return text.read_trajectories(spark, _through_text(text.trajectory_blocks(p, extra=("stay",)), "trajectories"), extra=("stay",))


@query(f"WITH {TRIPS} SELECT oid::VARCHAR AS oid, tid, pos, date_trunc('second', time) AS time, round(lat, 7) AS lat, round(lng, 7) AS lng, CASE WHEN seq % 5 > 0 THEN (seq % 5692)::INT END AS eid, CASE WHEN seq % 5 > 0 THEN round(lat, 7) END AS proj_lat, CASE WHEN seq % 5 > 0 THEN (seq % 40)::DOUBLE END AS error FROM trips")
def src_matched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("seq") % 5 > 0
    m = {"eid": (F.col("seq") % 5692).cast("int"), "proj_lat": F.col("lat"), "proj_lng": F.col("lng"), "error": (F.col("seq") % 40).cast("double"), "offset": F.lit(1.5)}
    p = _trips(spark, sf_dir).withColumns({k: F.when(ok, v) for k, v in m.items()})
    out = text.read_trajectories(spark, _through_text(text.trajectory_blocks(p, matched=True), "matched"), matched=True)
    return out.drop("proj_lng", "offset")


@query(f"WITH {S.PATHS} SELECT pid::VARCHAR AS pid, pos, enter_time, leave_time, eid::INT AS eid FROM paths")
def src_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.paths(spark, sf_dir).withColumn("oid", F.col("pid"))
    return text.read_paths(spark, _through_text(text.path_blocks(p), "paths")).drop("oid")


@query(f"WITH {TRIPS} SELECT tid, oid::VARCHAR AS oid, date_trunc('second', min(time)) AS start_time, count(*)::INT AS n, round(sum(round(lat, 7)), 6) AS lat FROM trips GROUP BY tid, oid HAVING count(*) > 1")
def src_wkt_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as WKT in CSV, read back."""
    path = scratch_path(spark, "wkt")
    out = text.trajectories_to_wkt(_trips(spark, sf_dir))
    out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_time", "end_time")}).write.csv(path, header=True)
    back = text.read_wkt_csv(spark, path)
    total = F.aggregate("pts", F.lit(0.0), lambda s, p: s + p["lat"])
    return back.select("tid", "oid", "start_time", F.size("pts").alias("n"), r(total).alias("lat"))


@query(f"WITH {S.GPS}, o AS (SELECT *, count(*) OVER (PARTITION BY oid) AS n FROM gps) SELECT oid::VARCHAR AS oid, date_trunc('second', time) AS time, lat, lng FROM o WHERE n > 1")
def src_taxi_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as one CSV folder per object, longitude first, read back by the reader; objects of one point go."""
    path = scratch_path(spark, "taxi")
    p = X.gps(spark, sf_dir).select(F.col("oid").alias("taxi"), F.col("oid").cast("string").alias("id"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("t"), "lng", "lat")
    p.repartition("taxi").write.partitionBy("taxi").csv(path)
    return text.read_taxi_logs(spark, f"{path}/*", r"taxi=([^/]+)/[^/]+$")


@query(f"WITH {S.PATHS} SELECT eid, count(*) AS n_visits, count(DISTINCT pid) AS n_paths FROM paths GROUP BY eid")
def src_active_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.paths(spark, sf_dir).groupBy("eid").agg(F.count(F.lit(1)).alias("n_visits"), F.countDistinct("pid").alias("n_paths"))


@query(f"WITH {S.PATHS}, {S.EDGES} SELECT eid, u, v, round({S.hav('ulat', 'ulng', 'vlat', 'vlng')}, 2) AS m FROM edges WHERE eid IN (SELECT eid FROM paths WHERE enter_time >= TIMESTAMP '1995-01-01')")
def snk_active_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the network that some path visits since 1995."""
    active = X.paths(spark, sf_dir).where(F.col("enter_time") >= F.lit("1995-01-01").cast("timestamp")).select("eid").distinct()
    a, b = F.element_at("coords", 1), F.element_at("coords", -1)
    return X.lattice_edges(spark).join(active, "eid", "left_semi").select("eid", "u", "v", r(geo.haversine_m(a["lat"], a["lng"], b["lat"], b["lng"]), 2).alias("m"))


@query(f"WITH {S.PATHS}, {S.EDGES}, e AS (SELECT pid, pos, u, v, p.eid, lag(v) OVER (PARTITION BY pid ORDER BY pos) AS before FROM paths p JOIN edges USING (eid)) SELECT pid, count(*)::INT AS n_edges, sum(2 + CASE WHEN eid % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN before = u THEN 1 ELSE 0 END)::INT AS n_points FROM e GROUP BY pid")
def snk_path_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.paths_to_wkt(X.paths(spark, sf_dir), X.lattice_edges(spark))
    return out.select("pid", "n_edges", (F.size(F.split("wkt", ","))).alias("n_points"))


TRAILS = f"""{S.GPS}, c AS (SELECT oid AS region, time, seq, (floor((lat - 34.2::DOUBLE) / 0.0004::DOUBLE) * 100000 + floor((lng - 108.9::DOUBLE) / 0.0004::DOUBLE))::BIGINT AS v FROM gps),
mv AS (SELECT *, lag(v) OVER (PARTITION BY region ORDER BY time, seq) AS u FROM c), de AS (SELECT DISTINCT region, least(u, v) AS u, greatest(u, v) AS v FROM mv WHERE u IS NOT NULL AND u <> v),
te AS (SELECT region, (row_number() OVER (PARTITION BY region ORDER BY u, v) - 1)::BIGINT AS eid, u, v, 34.2::DOUBLE + ((u // 100000)::DOUBLE + 0.5::DOUBLE) * 0.0004::DOUBLE AS y1, 108.9::DOUBLE + ((u % 100000)::DOUBLE + 0.5::DOUBLE) * 0.0004::DOUBLE AS x1,
  34.2::DOUBLE + ((v // 100000)::DOUBLE + 0.5::DOUBLE) * 0.0004::DOUBLE AS y2, 108.9::DOUBLE + ((v % 100000)::DOUBLE + 0.5::DOUBLE) * 0.0004::DOUBLE AS x2 FROM de),
tb AS (SELECT region, u AS node, v AS other FROM te UNION SELECT region, v, u FROM te)"""


@query(f"WITH {TRAILS} SELECT region, eid, u, v, round({S.hav('y1', 'x1', 'y2', 'x2')}, 4) AS length FROM te")
def net_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trail_edges(spark, sf_dir).select("region", "eid", "u", "v", r("length", 4).alias("length"))


@query(f"WITH {TRAILS} SELECT region, eid, u, v, round(y1, 8) AS first_lat FROM te UNION ALL SELECT region, max(eid) OVER (PARTITION BY region) + row_number() OVER (PARTITION BY region ORDER BY eid), v, u, round(y2, 8) FROM te")
def net_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.to_directed(X.trail_edges(spark, sf_dir)).select("region", "eid", "u", "v", r(F.element_at("coords", 1)["lat"], 8).alias("first_lat"))


@query(f"WITH {TRAILS} SELECT region, eid, eid AS new_eid FROM te UNION ALL SELECT region, max(eid) OVER (PARTITION BY region) + row_number() OVER (PARTITION BY region ORDER BY eid), eid FROM te")
def net_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.to_undirected(N.to_directed(X.trail_edges(spark, sf_dir)))[1]


@query(f"WITH {TRAILS} SELECT region, u, v FROM te WHERE eid % 3 > 0 UNION ALL SELECT region, min(u), max(v) FROM te GROUP BY region HAVING min(u) < max(v)")
def net_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third edge removed, one long edge added to each region."""
    e = X.trail_edges(spark, sf_dir).select("region", "eid", "u", "v")
    gone = e.where("eid % 3 = 0").select("region", "eid")
    new = e.groupBy("region").agg(F.min("u").alias("u"), F.max("v").alias("v")).where("u < v")
    return e.join(gone, ["region", "eid"], "left_anti").select("region", "u", "v").unionByName(new)


@query(f"""WITH {TRAILS}, n AS (SELECT *, greatest(ceil({S.hav('y1', 'x1', 'y2', 'x2')} / 200), 1)::INT AS n FROM te), p AS (SELECT *, unnest(generate_series(0, n - 1))::INT AS part FROM n)
SELECT region, eid, part, round(y1 + part::DOUBLE / n * (y2 - y1), 8) AS lat1, round(x1 + part::DOUBLE / n * (x2 - x1), 8) AS lng1, round(y1 + (part + 1)::DOUBLE / n * (y2 - y1), 8) AS lat2 FROM p""")
def net_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = N.densify(X.trail_edges(spark, sf_dir), 200.0)
    return d.select("region", "eid", "part", r("from.lat", 8).alias("lat1"), r("from.lng", 8).alias("lng1"), r("to.lat", 8).alias("lat2"))


@query(f"""WITH {TRAILS}, d AS (SELECT *, sqrt(pow(y1 - y2, 2) + pow((x1 - x2) * cos(radians(y1)), 2)) * 111111 AS d FROM te), n AS (SELECT *, CASE WHEN d > 150 THEN trunc(d / 100)::INT + 1 ELSE 1 END AS n FROM d), p AS (SELECT *, unnest(generate_series(0, n - 1))::INT AS part FROM n)
SELECT region, eid, part, round(y1 * (1 - part::DOUBLE / n) + y2 * (part::DOUBLE / n), 8) AS lat1, round(x1 * (1 - (part + 1)::DOUBLE / n) + x2 * ((part + 1)::DOUBLE / n), 8) AS lng2 FROM p""")
def net_densify_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = N.densify_metric(X.trail_edges(spark, sf_dir), 150.0, 100.0)
    return d.select("region", "eid", "part", r("lat1", 8).alias("lat1"), r("lng2", 8).alias("lng2"))


@query(f"WITH {TRAILS} SELECT region, node, count(*) AS degree FROM tb GROUP BY region, node")
def net_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.degrees(X.trail_edges(spark, sf_dir))


@query(f"WITH {TRAILS}, d AS (SELECT region, node FROM tb GROUP BY region, node HAVING count(*) = 1) SELECT region, u, v FROM te WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.region = te.region AND d.node = te.u) AND NOT EXISTS (SELECT 1 FROM d WHERE d.region = te.region AND d.node = te.v)")
def net_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.prune_dead_ends(X.trail_edges(spark, sf_dir)).select("region", "u", "v")


@query(f"""WITH {TRAILS}, s AS (SELECT region, min(u) AS start FROM te GROUP BY region), h AS (SELECT region, start, start AS node, 0 AS hop FROM s UNION ALL SELECT s.region, start, other, 1 FROM s JOIN tb ON tb.region = s.region AND node = start
 UNION ALL SELECT s.region, start, b.other, 2 FROM s JOIN tb a ON a.region = s.region AND a.node = start JOIN tb b ON b.region = s.region AND b.node = a.other) SELECT region, start, node, min(hop)::INT AS hop FROM h GROUP BY region, start, node""")
def net_within_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.trail_edges(spark, sf_dir)
    return N.within_hops(e, e.groupBy("region").agg(F.min("u").alias("start")), 2)


@query(f"WITH {TRAILS} SELECT region, node, array_to_string(list(other ORDER BY other), ' ') AS neighbours FROM tb GROUP BY region, node")
def net_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.adjacency_lists(X.trail_edges(spark, sf_dir)).select("region", "node", F.array_join("neighbours", " ").alias("neighbours"))


@query(f"WITH {TRAILS}, n AS (SELECT region, node, row_number() OVER (PARTITION BY region ORDER BY node) - 1 AS i FROM (SELECT DISTINCT region, node FROM tb)), e AS (SELECT te.region, a.i, b.i AS j FROM te JOIN n a ON a.region = te.region AND a.node = u JOIN n b ON b.region = te.region AND b.node = v) SELECT region, '[' || string_agg('[' || i || ',' || j || ']', ',' ORDER BY i, j) || ']' AS edges FROM e GROUP BY region")
def net_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.trail_edges(spark, sf_dir)
    return N.graph_json(e, X.trail_nodes(e)).select("region", F.regexp_extract("json", r",(\[(\[\d+,\d+\],?)*\])\]$", 1).alias("edges"))


@query(f"""WITH RECURSIVE {TRAILS}, ln AS (SELECT region, u, v, {S.hav('y1', 'x1', 'y2', 'x2')} AS d FROM te), lb AS (SELECT * FROM ln UNION ALL SELECT region, v, u, d FROM ln),
dg AS (SELECT region, node, count(*) AS n, min(other) AS lo, max(other) AS hi FROM tb GROUP BY region, node),
w AS (SELECT t.region, t.node AS start, t.other AS first, t.node AS a, t.other AS b, [t.node, t.other] AS nodes FROM tb t JOIN dg USING (region, node) WHERE n > 2 UNION ALL
 SELECT w.region, w.start, w.first, w.b, CASE WHEN lo = w.a THEN hi ELSE lo END, list_append(nodes, CASE WHEN lo = w.a THEN hi ELSE lo END) FROM w JOIN dg ON dg.region = w.region AND dg.node = w.b WHERE n = 2),
ch AS (SELECT w.*, row_number() OVER (PARTITION BY w.region, least(start, b), greatest(start, b) ORDER BY start, first) AS k, len(nodes) // 2 AS m FROM w JOIN dg ON dg.region = w.region AND dg.node = w.b
 WHERE n = 1 OR (n > 2 AND (start < b OR (start = b AND first <= a)))),
pc AS (SELECT region, unnest(CASE WHEN k > 1 AND len(nodes) > 2 THEN [nodes[:m + 1], nodes[m + 1:]] ELSE [nodes] END) AS nodes FROM ch),
st AS (SELECT region, nodes, unnest(nodes[:-2]) AS u, unnest(nodes[2:]) AS v FROM pc),
sm AS (SELECT region, nodes, sum(d) AS length FROM st JOIN lb USING (region, u, v) GROUP BY region, nodes)
SELECT region, nodes[1] AS u, nodes[-1] AS v, array_to_string(nodes, ',') AS nodes, round(length, 4) AS length FROM sm
UNION ALL SELECT region, u, v, u || ',' || v, round(d, 4) FROM ln WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.region = ln.region AND least(st.u, st.v) = ln.u AND greatest(st.u, st.v) = ln.v)""")
def net_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.compress(X.trail_edges(spark, sf_dir)).select("region", "u", "v", F.array_join("nodes", ",").alias("nodes"), r("length", 4).alias("length"))


@query(f"""WITH RECURSIVE {TRAILS}, we AS (SELECT region, u, v, trunc({S.hav('y1', 'x1', 'y2', 'x2')} * 100)::BIGINT AS cm FROM te), wb AS (SELECT region, u AS a, v AS b, cm FROM we UNION ALL SELECT region, v, u, cm FROM we),
src AS (SELECT region, min(u) AS source FROM te GROUP BY region),
far(region, node, cm) USING KEY (region, node) AS (SELECT region, source, 0::BIGINT FROM src UNION
 (SELECT w.region, w.b, min(f.cm + w.cm) FROM far f JOIN wb w ON w.region = f.region AND w.a = f.node LEFT JOIN recurring.far o ON o.region = w.region AND o.node = w.b WHERE o.cm IS NULL OR f.cm + w.cm < o.cm GROUP BY w.region, w.b))
SELECT n.region, s.source, n.node, coalesce(f.cm, -1)::BIGINT AS cm FROM (SELECT DISTINCT region, node FROM tb) n JOIN src s ON s.region = n.region LEFT JOIN far f ON f.region = n.region AND f.node = n.node""")
def rte_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest distances in centimetres from the first node of each region."""
    e = X.trail_edges(spark, sf_dir)
    return N.distances_cm(e, e.groupBy("region").agg(F.min("u").alias("source")))


def _tile(lat: str, lng: str) -> list[str]:
    return [f"round_even((34.279658::DOUBLE - {lat}) / (34.279658::DOUBLE - 34.206385::DOUBLE) * 400, 3)", f"round_even(({lng} - 108.917423::DOUBLE) / (108.99286::DOUBLE - 108.917423::DOUBLE) * 400, 3)"]


@query(f"""WITH {TRAILS}, e AS (SELECT region, {_tile('y1', 'x1')[0]} AS r1, {_tile('y1', 'x1')[1]} AS c1, {_tile('y2', 'x2')[0]} AS r2, {_tile('y2', 'x2')[1]} AS c2 FROM te),
b AS (SELECT region, r1, c1, r2, c2 FROM e WHERE r1 <> r2 OR c1 <> c2 UNION SELECT region, r2, c2, r1, c1 FROM e WHERE r1 <> r2 OR c1 <> c2)
SELECT region, r1 AS row, c1 AS col, count(*) AS degree, round(sum(r2), 3) AS rows, round(sum(c2), 3) AS cols FROM b GROUP BY region, r1, c1""")
def snk_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks as adjacency lists of pixels (both ways, no loops), written, read back and opened again."""
    path = scratch_path(spark, "adjacency")
    N.to_pixel_adjacency(X.trail_edges(spark, sf_dir), X.BOX, 400).write.parquet(path)
    n = N.read_pixel_adjacency(spark, path)
    return n.groupBy("region", F.col("r1").alias("row"), F.col("c1").alias("col")).agg(F.count(F.lit(1)).alias("degree"), r(F.sum("r2"), 3).alias("rows"), r(F.sum("c2"), 3).alias("cols"))
