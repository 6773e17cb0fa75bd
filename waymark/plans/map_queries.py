"""Queries on grids, spatial joins and map matching, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import matching, spatial
from ..operators import trajectory as T
from ..sources import fixtures as X
from ..sources.scratch import scratch_path
from . import sql as S
from .trajectory_queries import travel_sql

QUERIES, SQL = {}, {}
GRID = spatial.Grid(X.BOX, 40, 30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


_DY, _DX = (f"{x!r}::DOUBLE" for x in GRID.steps)
_IN = "lat >= 34.206385::DOUBLE AND lat < 34.279658::DOUBLE AND lng >= 108.917423::DOUBLE AND lng < 108.99286::DOUBLE"


@query(f"""WITH {S.GPS}, c AS (SELECT oid, seq, CASE WHEN {_IN} THEN floor((lat - 34.206385::DOUBLE) / {_DY})::INT END AS row, CASE WHEN {_IN} THEN floor((lng - 108.917423::DOUBLE) / {_DX})::INT END AS col FROM gps)
SELECT oid, seq, row, col, 39 - row AS matrix_row, round(34.206385::DOUBLE + row * {_DY}, 8) AS min_lat, round(108.917423::DOUBLE + (col + 1) * {_DX}, 8) AS max_lng FROM c""")
def idx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.gps(spark, sf_dir).withColumn("c", GRID.cell(F.col("lat"), F.col("lng")))
    b = GRID.bounds(F.col("c.row"), F.col("c.col"))
    return c.select("oid", "seq", "c.row", "c.col", GRID.matrix(F.col("c"))["row"].alias("matrix_row"), r(b["min_lat"], 8).alias("min_lat"), r(b["max_lng"], 8).alias("max_lng"))


@query(f"""WITH {S.GPS}, b AS (SELECT oid, min(lat) AS y0, min(lng) AS x0, max(lat) AS y1, max(lng) AS x1 FROM gps GROUP BY oid),
k AS (SELECT oid, floor((greatest(y0, 34.206385::DOUBLE) - 34.206385::DOUBLE) / {_DY})::INT AS r0, floor((least(y1, 34.279658::DOUBLE) - 1e-7 - 34.206385::DOUBLE) / {_DY})::INT AS r1,
 floor((greatest(x0, 108.917423::DOUBLE) - 108.917423::DOUBLE) / {_DX})::INT AS c0, floor((least(x1, 108.99286::DOUBLE) - 1e-7 - 108.917423::DOUBLE) / {_DX})::INT AS c1 FROM b)
SELECT oid, unnest(generate_series(r0, r1))::INT AS row, c AS col FROM (SELECT oid, r0, r1, unnest(generate_series(c0, c1))::INT AS c FROM k WHERE r1 >= r0 AND c1 >= c0)""")
def idx_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.gps(spark, sf_dir).groupBy("oid").agg(F.min("lat").alias("y0"), F.min("lng").alias("x0"), F.max("lat").alias("y1"), F.max("lng").alias("x1"))
    return b.select("oid", F.explode(GRID.covered(*[F.col(c) for c in ("y0", "x0", "y1", "x1")])).alias("c")).select("oid", "c.row", "c.col")


@query(f"""WITH {S.GPS}, {S.EDGES}, b AS (SELECT oid, min(lat) AS y0, min(lng) AS x0, max(lat) AS y1, max(lng) AS x1 FROM gps GROUP BY oid)
SELECT oid, eid FROM b JOIN edges ON y0 <= greatest(ulat, vlat) AND least(ulat, vlat) <= y1 AND x0 <= greatest(ulng, vlng) AND least(ulng, vlng) <= x1""")
def idx_edges_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.gps(spark, sf_dir).groupBy("oid").agg(F.min("lat").alias("b0"), F.min("lng").alias("b1"), F.max("lat").alias("b2"), F.max("lng").alias("b3"))
    return spatial.box_join(b, spatial.with_box(X.lattice_edges(spark)), levels=6).select("oid", "eid")


@query(f"""WITH {S.GPS}, {S.NODES}, d AS (SELECT oid, seq, node_id AS node, {S.hav('gps.lat', 'gps.lng', 'nodes.lat', 'nodes.lng')} AS dist FROM gps JOIN nodes ON abs(gps.lat - nodes.lat) < 0.004 AND abs(gps.lng - nodes.lng) < 0.005)
SELECT oid, seq, node, round(dist, 4) AS dist, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY oid, seq ORDER BY dist, node) AS rank FROM d WHERE dist <= 300) WHERE rank <= 3""")
def idx_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = X.lattice_nodes(spark).select(F.col("node_id").alias("node"), F.col("lat").alias("y"), F.col("lng").alias("x"))
    return spatial.nearest(X.gps(spark, sf_dir), ["oid", "seq"], nodes, 3, 300.0).select("oid", "seq", "node", r("dist", 4).alias("dist"), "rank")


@query(f"""WITH {S.GPS}, {S.NODES}, p AS (SELECT oid, seq, lat + 26 AS lat, lng FROM gps), n AS (SELECT node_id, lat + 26 AS lat, lng FROM nodes),
d AS (SELECT oid, seq, node_id AS node, {S.hav('p.lat', 'p.lng', 'n.lat', 'n.lng')} AS dist FROM p JOIN n ON abs(p.lat - n.lat) < 0.004 AND abs(p.lng - n.lng) < 0.008)
SELECT oid, seq, node, round(dist, 4) AS dist, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY oid, seq ORDER BY dist, node) AS rank FROM d WHERE dist <= 300) WHERE rank <= 3""")
def idx_nearest_north(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at 60 degrees north, where a degree of longitude is half as long."""
    nodes = X.lattice_nodes(spark).select(F.col("node_id").alias("node"), (F.col("lat") + 26).alias("y"), F.col("lng").alias("x"))
    points = X.gps(spark, sf_dir).withColumn("lat", F.col("lat") + 26)
    return spatial.nearest(points, ["oid", "seq"], nodes, 3, 300.0).select("oid", "seq", "node", r("dist", 4).alias("dist"), "rank")


@query(f"""WITH {S.GPS}, t AS (SELECT oid, time_bucket(INTERVAL 1 DAY, time) AS day, min(lat) AS y0, min(lng) AS x0, max(lat) AS y1, max(lng) AS x1 FROM gps GROUP BY 1, 2),
b AS (SELECT oid AS asked, avg(lat) - 0.002 AS b0, avg(lng) - 0.002 AS b1, avg(lat) + 0.002 AS b2, avg(lng) + 0.002 AS b3 FROM gps GROUP BY oid)
SELECT asked, count(*) AS n_days, count(DISTINCT oid) AS n_objects FROM b JOIN t ON b0 <= y1 AND y0 <= b2 AND b1 <= x1 AND x0 <= b3 GROUP BY asked""")
def idx_trips_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of objects whose box meets a box around each object's usual place."""
    p = X.gps(spark, sf_dir)
    ends = [F.min("lat").alias("y0"), F.min("lng").alias("x0"), F.max("lat").alias("y1"), F.max("lng").alias("x1")]
    trips = p.groupBy("oid", F.to_date("time").alias("day")).agg(*ends)
    # Places are added up in order: points lie on the sides of boxes, where the last bit of a mean decides.
    mean = lambda k: F.aggregate("p", F.lit(0.0), lambda t, q: t + q[k]) / F.size("p")
    c = p.groupBy(F.col("oid").alias("asked")).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("p")).select("asked", mean("lat").alias("y"), mean("lng").alias("x"))
    box = c.select("asked", (F.col("y") - 0.002).alias("b0"), (F.col("x") - 0.002).alias("b1"), (F.col("y") + 0.002).alias("b2"), (F.col("x") + 0.002).alias("b3"))
    return spatial.box_counts(box, trips.withColumnRenamed("oid", "owner")).withColumnsRenamed({"n": "n_days", "n_owners": "n_objects"})


@query(f"""WITH {S.GPS}, {S.NODES}, c AS (SELECT oid, avg(lat) AS lat, avg(lng) AS lng FROM gps GROUP BY oid), d AS (SELECT oid, node_id AS node, {S.hav('c.lat', 'c.lng', 'nodes.lat', 'nodes.lng')} AS dist FROM c CROSS JOIN nodes)
SELECT oid, node, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY dist, node) AS k FROM d) WHERE k <= 4""")
def idx_nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nodes nearest to each object's centre, however far."""
    c = X.gps(spark, sf_dir).groupBy("oid").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    nodes = X.lattice_nodes(spark).select(F.col("node_id").alias("node"), F.col("lat").alias("y"), F.col("lng").alias("x"))
    return spatial.nearest_any(c, ["oid"], nodes, 4, 100.0).select("oid", "node", r("dist", 4).alias("dist"))


def _along(a: str, b: str) -> str:
    return f"{S.hav(f'{a}1', f'{b}1', 'lat', 'lng')} * cos(radians({S.brg(f'{a}1', f'{b}1', 'lat', 'lng')} - {S.brg(f'{a}1', f'{b}1', f'{a}2', f'{b}2')}))"


CANDIDATES = f"""{S.GPS}, {S.SEGMENTS}, near AS (SELECT oid, seq, time, lat, lng, eid, i, lat1, lng1, lat2, lng2, {S.hav('lat1', 'lng1', 'lat2', 'lng2')} AS len, {_along('lat', 'lng')} AS along
  FROM gps JOIN segs ON lat BETWEEN least(lat1, lat2) - 0.0006 AND greatest(lat1, lat2) + 0.0006 AND lng BETWEEN least(lng1, lng2) - 0.0007 AND greatest(lng1, lng2) + 0.0007),
rt AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, along / len)) AS rate FROM near),
pj AS (SELECT *, CASE WHEN rate >= 1 THEN lat2 WHEN rate <= 0 THEN lat1 ELSE lat1 + rate * (lat2 - lat1) END AS py, CASE WHEN rate >= 1 THEN lng2 WHEN rate <= 0 THEN lng1 ELSE lng1 + rate * (lng2 - lng1) END AS px FROM rt),
er AS (SELECT *, {S.hav('lat', 'lng', 'py', 'px')} AS error FROM pj),
cand AS (SELECT oid, seq, time, lat, lng, eid, error, py, {S.hav('lat1', 'lng1', 'py', 'px')} + CASE WHEN i = 1 THEN len ELSE 0 END AS offs FROM (SELECT *, row_number() OVER (PARTITION BY oid, seq, eid ORDER BY error, i) AS k FROM er) WHERE k = 1 AND error <= 50)"""


@query(f"WITH {CANDIDATES} SELECT oid, seq, eid, round(error, 3) AS error, round(offs, 2) AS \"offset\" FROM cand")
def map_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spatial.candidates(X.gps(spark, sf_dir), X.lattice_edges(spark), 50.0)
    return c.select("oid", "seq", "eid", r("error", 3).alias("error"), r("offset", 2).alias("offset"))


@query(f"""WITH {CANDIDATES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY oid, seq ORDER BY round(error, 6), eid) AS k FROM cand) WHERE k = 1),
s AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(offs) OVER w AS poff, lag(eid) OVER w AS peid FROM best WINDOW w AS (PARTITION BY oid ORDER BY time, seq))
SELECT oid, seq, eid, round({math.log(1 / (math.sqrt(2 * math.pi) * 50))!r}::DOUBLE - 0.5 * pow(error / 50, 2), 5) AS emission,
 round(CASE WHEN peid = eid THEN {math.log(0.5)!r}::DOUBLE - abs({S.hav('plat', 'plng', 'lat', 'lng')} - abs(offs - poff)) / 2 END, 2) AS transition FROM s""")
def map_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission of each point's nearest candidate, and the transition from the point before where both lie on one edge."""
    c = spatial.candidates(X.gps(spark, sf_dir), X.lattice_edges(spark), 50.0)
    best = c.withColumn("k", F.row_number().over(Window.partitionBy("oid", "seq").orderBy(F.round("error", 6), "eid"))).where("k = 1")
    w = T.ordered()
    p = {f"p{k}": F.lag(k).over(w) for k in ("lat", "lng", "offset", "eid")}
    best = best.withColumns(p)
    straight = geo.haversine_m(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))
    move = F.when(F.col("peid") == F.col("eid"), matching.transition(F.abs(F.col("offset") - F.col("poffset")), straight))
    return best.select("oid", "seq", "eid", r(matching.emission(F.col("error")), 5).alias("emission"), r(move, 2).alias("transition"))


@query(f"""WITH {CANDIDATES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY oid, seq ORDER BY round(error, 6), eid) AS k FROM cand) WHERE k = 1),
m AS (SELECT g.oid, g.seq, g.time, CASE WHEN error <= 20 THEN eid END AS ok FROM gps g LEFT JOIN best b ON g.oid = b.oid AND g.seq = b.seq),
x AS (SELECT *, sum(CASE WHEN ok IS NULL THEN 0 ELSE 1 END) OVER w AS run, last_value(ok IGNORE NULLS) OVER (PARTITION BY oid ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_eid,
  first_value(ok IGNORE NULLS) OVER (PARTITION BY oid ORDER BY time, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_eid FROM m WINDOW w AS (PARTITION BY oid ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT oid, seq, run::BIGINT AS run, prev_eid, next_eid FROM x WHERE ok IS NULL""")
def seg_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.gps(spark, sf_dir)
    c = spatial.candidates(p, X.lattice_edges(spark), 50.0)
    best = c.withColumn("k", F.row_number().over(Window.partitionBy("oid", "seq").orderBy(F.round("error", 6), "eid"))).where("k = 1").select("oid", "seq", "eid", "error")
    return T.unmatched_runs(p.join(best, ["oid", "seq"], "left"), 20.0).select("oid", "seq", "run", "prev_eid", "next_eid")


@query(f"""WITH RECURSIVE {CANDIDATES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY oid, seq ORDER BY round(error, 6), eid) AS k FROM cand) WHERE k = 1),
{S.steps()}, cut AS (SELECT *, sum(CASE WHEN epoch_us(time) - epoch_us(ptime) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY oid ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment FROM steps),
sg AS (SELECT oid::VARCHAR || '/' || segment AS oid, oid AS object, segment, seq, time, lat, lng FROM (SELECT *, count(*) OVER (PARTITION BY oid, segment) AS n FROM cut) WHERE n > 1),
{travel_sql(300, 6).replace('FROM gps', 'FROM sg')}
SELECT p.object AS oid, p.segment, part::INT AS part, (p.k - lo)::INT AS pos, p.seq, b.eid FROM pieces c JOIN pts p ON p.oid = c.oid AND p.k >= lo AND p.k < hi LEFT JOIN best b ON b.oid = p.object AND b.seq = p.seq""")
def seg_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched points cut at gaps of a day, then at stays; each keeps its edge."""
    p = X.gps(spark, sf_dir)
    c = spatial.candidates(p, X.lattice_edges(spark), 50.0)
    best = c.withColumn("k", F.row_number().over(Window.partitionBy("oid", "seq").orderBy(F.round("error", 6), "eid"))).where("k = 1").select("oid", "seq", "eid")
    m = T.matched_segments(p.join(best, ["oid", "seq"], "left"), 86400.0, 300.0, 6 * 3600)
    return m.select("oid", "segment", "part", "pos", "seq", "eid")


@query()
def map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.match(X.gps(spark, sf_dir), X.lattice_edges(spark))
    return m.select("oid", "seq", "eid", r("error", 3).alias("error"), r("offset", 2).alias("offset"))


@query()
def map_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, path = X.lattice_edges(spark), scratch_path(spark, "matched")
    matching.match(X.gps(spark, sf_dir), edges).write.parquet(path)  # read twice: as points, and for the parts of the network
    return matching.to_paths(spark.read.parquet(path), edges)


def _directed(spark: SparkSession) -> DataFrame:
    """The lattice with both directions of each street but every fourth, which is one-way."""
    e = X.lattice_edges(spark)
    back = e.where("eid % 4 <> 1").select((F.col("eid") + 5692).alias("eid"), F.col("v").alias("u"), F.col("u").alias("v"), F.reverse("coords").alias("coords"), "length")
    return e.unionByName(back)


@query()
def map_match_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching to a directed network with one-way streets."""
    m = matching.match(X.gps(spark, sf_dir), _directed(spark), directed=True)
    return m.select("oid", "seq", "eid", r("error", 3).alias("error"), r("offset", 2).alias("offset"))
