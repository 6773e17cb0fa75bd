"""Queries on trajectories, each over the whole events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, temporal
from ..operators import raster
from ..operators import trajectory as T
from ..sources.fixtures import BOX, gps
from . import sql as S

QUERIES, SQL = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


START, END = "2024-01-03", "2024-01-28"
FILTER_BOX = (34.20, 108.90, 34.30, 109.00)
SPEED = """RECURSIVE {gps}, pts AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY time, seq) AS k, count(*) OVER (PARTITION BY oid) AS n FROM gps),
walk AS (SELECT oid, k, seq, time, lat, lng, time AS t0, lat AS alat, lng AS alng, true AS ok FROM pts WHERE k = 1
  UNION ALL SELECT oid, k, seq, time, lat, lng, CASE WHEN good THEN time ELSE t0 END, CASE WHEN good THEN lat ELSE alat END, CASE WHEN good THEN lng ELSE alng END, good FROM (
    SELECT p.*, w.t0, w.alat, w.alng, epoch_us(p.time) > epoch_us(w.t0) AND {dist} <= 1.0 * (epoch_us(p.time) - epoch_us(w.t0)) / 1e6 AS good FROM walk w JOIN pts p ON p.oid = w.oid AND p.k = w.k + 1)),
clean AS (SELECT oid, seq, time, lat, lng FROM (SELECT *, count(*) OVER (PARTITION BY oid) AS c FROM walk WHERE ok) WHERE c > 1)""".format(gps=S.GPS, dist=S.hav("w.alat", "w.alng", "p.lat", "p.lng"))


@query(f"""WITH {S.GPS}, {S.steps()} SELECT oid, seq, round({S.hav('plat', 'plng', 'lat', 'lng')}, 6) AS m, round({S.hav('plat', 'plng', 'lat', 'lng', '6371000')}, 6) AS m_csv,
round(sqrt(pow(plat - lat, 2) + pow((plng - lng) * cos(radians(plat)), 2)), 9) AS deg, round(sqrt(pow(plat - lat, 2) + pow((plng - lng) * cos(radians(plat)), 2)) * 111111, 6) AS planar_m,
round({S.brg('plat', 'plng', 'lat', 'lng')}, 6) AS bearing, round(plat + 0.25::DOUBLE * (lat - plat), 9) AS q_lat, round(plng + 0.25::DOUBLE * (lng - plng), 9) AS q_lng FROM steps WHERE k > 1""")
def geo_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.ordered()
    p = gps(spark, sf_dir).withColumns({"plat": F.lag("lat").over(w), "plng": F.lag("lng").over(w)}).where("plat is not null")
    a = [F.col(c) for c in ("plat", "plng", "lat", "lng")]
    q = geo.interpolate(*a, F.lit(0.25))
    return p.select("oid", "seq", r(geo.haversine_m(*a)).alias("m"), r(geo.haversine_m(*a, radius=geo.EARTH_CSV_M)).alias("m_csv"), r(geo.degree_distance(*a), 9).alias("deg"), r(geo.planar_m(*a)).alias("planar_m"), r(geo.bearing(*a)).alias("bearing"), r(q[0], 9).alias("q_lat"), r(q[1], 9).alias("q_lng"))


def _projected(clamped: bool) -> str:
    rate = "CASE WHEN len = 0 THEN 0::DOUBLE ELSE along / len END"
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {rate}))" if clamped else rate


_A, _B = ("34.23", "108.93"), ("34.25", "108.96")
_AB = [f"{x}::DOUBLE" for x in (*_A, *_B)]


@query(f"""WITH {S.GPS}, a AS (SELECT *, {S.hav(*_AB)} AS len, {S.hav(*_AB[:2], 'lat', 'lng')} * cos(radians({S.brg(*_AB[:2], 'lat', 'lng')} - {S.brg(*_AB)})) AS along FROM gps),
b AS (SELECT *, {_projected(True)} AS rate, {_projected(False)} AS line_rate FROM a),
c AS (SELECT *, 34.23::DOUBLE + rate * (34.25::DOUBLE - 34.23::DOUBLE) AS y, 108.93::DOUBLE + rate * (108.96::DOUBLE - 108.93::DOUBLE) AS x,
  34.23::DOUBLE + line_rate * (34.25::DOUBLE - 34.23::DOUBLE) AS ly, 108.93::DOUBLE + line_rate * (108.96::DOUBLE - 108.93::DOUBLE) AS lx FROM b)
SELECT oid, seq, round(rate, 9) AS rate, round({S.hav('lat', 'lng', 'y', 'x')}, 4) AS dist, round(line_rate, 9) AS line_rate, round({S.hav('lat', 'lng', 'ly', 'lx')}, 4) AS line_dist FROM c""")
def geo_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = [float(x) for x in (*_A, *_B)]
    p, q = geo.project(*a, F.col("lat"), F.col("lng")), geo.project(*a, F.col("lat"), F.col("lng"), to_line=True)
    return gps(spark, sf_dir).select("oid", "seq", p.alias("p"), q.alias("q")).select("oid", "seq", r("p.rate", 9).alias("rate"), r("p.dist", 4).alias("dist"), r("q.rate", 9).alias("line_rate"), r("q.dist", 4).alias("line_dist"))


@query(f"""WITH {S.GPS}, s AS (SELECT *, lag(lat) OVER w AS y1, lag(lng) OVER w AS x1, lag(lat, 2) OVER w AS y0, lag(lng, 2) OVER w AS x0 FROM gps WINDOW w AS (PARTITION BY oid ORDER BY time, seq)),
t AS (SELECT *, trunc(degrees(atan2(y1 - y0, x1 - x0)))::INT AS p, trunc(degrees(atan2(lat - y1, lng - x1)))::INT AS q, sqrt(pow(y1 - y0, 2) + pow(x1 - x0, 2)) AS n1, sqrt(pow(lat - y1, 2) + pow(lng - x1, 2)) AS n2 FROM s WHERE y0 IS NOT NULL)
SELECT oid, seq, CASE WHEN p * q >= 0 THEN abs(p - q) WHEN abs(p) + abs(q) > 180 THEN 360 - abs(p) - abs(q) ELSE abs(p) + abs(q) END AS angle,
 round(CASE WHEN n1 = 0 OR n2 = 0 THEN 100000 ELSE sqrt(pow((y1 - y0) / n1 - (lat - y1) / n2, 2) + pow((x1 - x0) / n1 - (lng - x1) / n2, 2)) END, 6) AS turn,
 round(CASE WHEN sqrt(pow(lat - y1, 2) + pow((lng - x1) * cos(radians(40)), 2)) > 0 THEN (lat - y1) / sqrt(pow(lat - y1, 2) + pow((lng - x1) * cos(radians(40)), 2)) END, 9) AS dir_lat FROM t""")
def geo_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.ordered()
    lag = lambda c, k: F.lag(c, k).over(w)
    p = gps(spark, sf_dir).withColumns({"y1": lag("lat", 1), "x1": lag("lng", 1), "y0": lag("lat", 2), "x0": lag("lng", 2)}).where("y0 is not null")
    c = {k: F.col(k) for k in ("y0", "x0", "y1", "x1", "lat", "lng")}
    angle = geo.included_angle(c["y0"], c["x0"], c["y1"], c["x1"], c["y1"], c["x1"], c["lat"], c["lng"])
    turn = geo.angle_distance(c["y1"] - c["y0"], c["x1"] - c["x0"], c["lat"] - c["y1"], c["lng"] - c["x1"])
    return p.select("oid", "seq", angle.alias("angle"), r(turn).alias("turn"), r(geo.unit_direction(c["lat"] - c["y1"], c["lng"] - c["x1"])[0], 9).alias("dir_lat"))


@query(f"""WITH {S.GPS}, s AS (SELECT *, (lng - 108.93::DOUBLE) * cos(radians(34.23::DOUBLE)) AS x, lat - 34.23::DOUBLE AS y, 0.02::DOUBLE AS y2, 0.03::DOUBLE * cos(radians(34.23::DOUBLE)) AS x2 FROM gps),
t AS (SELECT *, sqrt(y2 * y2 + x2 * x2) AS len, (y2 * y + x2 * x) / sqrt(y2 * y2 + x2 * x2) AS along FROM s)
SELECT oid, seq, round(CASE WHEN along > len THEN sqrt(pow(y - y2, 2) + pow(x - x2, 2)) WHEN along < 0 THEN sqrt(y * y + x * x) ELSE sqrt(pow(y - along / len * y2, 2) + pow(x - along / len * x2, 2)) END, 9) AS deg,
 round(CASE WHEN hit THEN ix ELSE 0 END, 9) AS x, hit::INT AS hit FROM (SELECT *, coalesce(alpha >= 0 AND (ix - 108.91) * (109.0 - ix) + (iy - 34.21) * (34.27 - iy) >= 0, false) AS hit FROM (
  SELECT *, lng + alpha * 0.5 AS ix, lat + alpha * 1.0 AS iy FROM (SELECT *, (109.0::DOUBLE * 34.21::DOUBLE - 108.91::DOUBLE * 34.27::DOUBLE + lng * (34.27::DOUBLE - 34.21::DOUBLE) + lat * (108.91::DOUBLE - 109.0::DOUBLE))
   / (0.5::DOUBLE * 34.21::DOUBLE + 1.0::DOUBLE * 109.0::DOUBLE - 0.5::DOUBLE * 34.27::DOUBLE - 1.0::DOUBLE * 108.91::DOUBLE) AS alpha FROM t)))""")
def geo_segments_and_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    f = [F.lit(x) for x in (0.5, 1.0, 108.91, 34.21, 109.0, 34.27)]
    hit = geo.ray_edge(lng, lat, *f)
    return gps(spark, sf_dir).select("oid", "seq", r(geo.point_to_segment_degrees(34.23, 108.93, 34.25, 108.96, lat, lng), 9).alias("deg"), hit.alias("h")).select("oid", "seq", "deg", r("h.x", 9).alias("x"), "h.hit")


@query(f"""WITH {S.GPS}, b AS (SELECT oid, min(lat) AS y0, min(lng) AS x0, max(lat) AS y1, max(lng) AS x1 FROM gps GROUP BY oid)
SELECT oid, y0 AS min_lat, x0 AS min_lng, y1 AS max_lat, x1 AS max_lng, round({S.hav('y0', 'x0', 'y1', 'x0')}, 6) AS h, round({S.hav('y0', 'x0', 'y0', 'x1')}, 6) AS w, round((y0 + y1) / 2, 9) AS mid_lat,
 34.25 >= y0 AND 34.25 < y1 AND 108.95 >= x0 AND 108.95 < x1 AS has_centre,
 printf('POLYGON ((%.7f %.7f, %.7f %.7f, %.7f %.7f, %.7f %.7f, %.7f %.7f))', x0, y0, x0, y1, x1, y1, x1, y0, x0, y0) AS wkt FROM b""")
def geo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = gps(spark, sf_dir).groupBy("oid").agg(F.min("lat").alias("min_lat"), F.min("lng").alias("min_lng"), F.max("lat").alias("max_lat"), F.max("lng").alias("max_lng"))
    c = [F.col(x) for x in ("min_lat", "min_lng", "max_lat", "max_lng")]
    h, w = geo.haversine_m(c[0], c[1], c[2], c[1]), geo.haversine_m(c[0], c[1], c[0], c[3])
    return b.select("oid", *c, r(h).alias("h"), r(w).alias("w"), r((c[0] + c[2]) / 2, 9).alias("mid_lat"), geo.in_box(F.lit(34.25), F.lit(108.95), *c).alias("has_centre"), geo.wkt_box(*c).alias("wkt"))


@query(f"""WITH {S.GPS}, m AS (SELECT oid, seq, lat, lng, lng * 20037508.34::DOUBLE / 180 AS x, ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * 20037508.34::DOUBLE / 180 AS y FROM gps),
k AS (SELECT *, 108.917423::DOUBLE * 20037508.34::DOUBLE / 180 AS x0, 108.99286::DOUBLE * 20037508.34::DOUBLE / 180 AS x1, ln(tan((90 + 34.206385::DOUBLE) * pi() / 360)) / (pi() / 180) * 20037508.34::DOUBLE / 180 AS y0, ln(tan((90 + 34.279658::DOUBLE) * pi() / 360)) / (pi() / 180) * 20037508.34::DOUBLE / 180 AS y1 FROM m)
SELECT oid, seq, round(x, 4) AS x, round(y, 4) AS y, round((x - x0) / (x1 - x0) * 5625, 5) AS px, round((y1 - y) / (y1 - y0) * 6610, 5) AS py, round(lat, 9) AS back_lat, round(lng, 9) AS back_lng,
 round(6610 - trunc((lat - 34.206385::DOUBLE) / ((34.279658::DOUBLE - 34.206385::DOUBLE) / 6610)), 0)::INT AS draw_row, trunc(lat * 111111::DOUBLE / 30)::BIGINT AS cell_lat, printf('%.7f_%.7f', lat, lng) AS key FROM k""")
def geo_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    x, y = geo.to_mercator(lat, lng)
    px, py = geo.geo_to_pixel(lat, lng, BOX, 5625, 6610)
    back = geo.pixel_to_geo(px, py, BOX, 5625, 6610)
    return gps(spark, sf_dir).select("oid", "seq", r(x, 4).alias("x"), r(y, 4).alias("y"), r(px, 5).alias("px"), r(py, 5).alias("py"), r(back[0], 9).alias("back_lat"), r(back[1], 9).alias("back_lng"), geo.render_pixel(lat, lng, BOX, 6610, 5625)[0].alias("draw_row"), geo.cell_key(lat, lng, 30.0)[0].alias("cell_lat"), geo.location_key(lat, lng).alias("key"))


_DLAT, _DLNG, _ROWS, _COLUMNS = geo.region_grid(BOX, 400)


@query(f"""WITH {S.GPS}, k AS (SELECT *, floor((34.279658::DOUBLE - own) / {_DLAT!r}::DOUBLE) AS i, floor((CASE WHEN own IS NOT NULL THEN lng END - 108.917423::DOUBLE) / {_DLNG!r}::DOUBLE) AS j FROM (SELECT *, CASE WHEN lat < 34.279658 AND lng < 108.99286 THEN lat END AS own FROM gps)),
b AS (SELECT *, (i * {_COLUMNS} + j)::BIGINT AS region, 34.279658::DOUBLE - i * {_DLAT!r}::DOUBLE AS hi, 34.279658::DOUBLE - (i + 1) * {_DLAT!r}::DOUBLE AS lo, 108.917423::DOUBLE + j * {_DLNG!r}::DOUBLE AS west FROM k)
SELECT oid, seq, region, round((hi - lat) / (hi - lo) * 400, 4) AS row, round((lng - west) / (west + {_DLNG!r}::DOUBLE - west) * 400, 4) AS col,
 (lat - 34.2::DOUBLE) * 111111::DOUBLE > 20 AND (lat - 34.2::DOUBLE) * 111111::DOUBLE < 6980 AND (lng - 108.9::DOUBLE) * 111111::DOUBLE * cos(radians(34.2::DOUBLE)) > 20 AND (lng - 108.9::DOUBLE) * 111111::DOUBLE * cos(radians(34.2::DOUBLE)) < 6980 AS inside FROM b""")
def geo_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    own = F.when((lat < BOX[2]) & (lng < BOX[3]), lat)
    p = gps(spark, sf_dir).withColumn("region", (F.floor((F.lit(BOX[2]) - own) / _DLAT) * _COLUMNS + F.floor((lng - BOX[1]) / _DLNG)).cast("long"))
    p = p.withColumn("b", geo.region_box(F.col("region"), BOX, 400))
    row, col = geo.geo_to_rc(lat, lng, F.col("b"), 400)
    return p.select("oid", "seq", "region", r(row, 4).alias("row"), r(col, 4).alias("col"), geo.in_bound_with_margin(lat, lng, 7000.0, 20.0, 34.2, 108.9).alias("inside"))


@query(f"""WITH {S.GPS}, p AS (SELECT oid, lat, lng, hour(time) < 12 AS am FROM gps),
d AS (SELECT a.oid, a.lat AS alat, a.lng AS alng, b.lat AS blat, b.lng AS blng, {S.hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS m FROM p a JOIN p b ON a.oid = b.oid WHERE a.am AND NOT b.am),
x AS (SELECT oid, max(m) AS m FROM (SELECT oid, alat, alng, min(m) AS m FROM d GROUP BY oid, alat, alng) GROUP BY oid),
y AS (SELECT oid, max(m) AS m FROM (SELECT oid, blat, blng, min(m) AS m FROM d GROUP BY oid, blat, blng) GROUP BY oid)
SELECT x.oid, round(greatest(x.m, y.m), 4) AS hausdorff_m FROM x JOIN y ON x.oid = y.oid""")
def geo_hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    am = F.hour("time") < 12
    half = lambda c: F.collect_list(F.when(c, F.struct("lat", "lng")))
    g = gps(spark, sf_dir).groupBy("oid").agg(half(am).alias("a"), half(~am).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    return g.select("oid", r(geo.hausdorff_m(F.col("a"), F.col("b")), 4).alias("hausdorff_m"))


@query(f"""WITH {S.GPS} SELECT oid, seq, (hour(time) * 60 + minute(time)) // 30 AS daily, CASE WHEN time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-20' THEN floor((epoch_us(time) - epoch_us(TIMESTAMP '2024-01-05')) / 1800000000)::INT END AS slot FROM gps""")
def tim_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("time")
    return gps(spark, sf_dir).select("oid", "seq", temporal.daily_slot(t, 30).alias("daily"), temporal.slot(t, "2024-01-05", "2024-01-20", 30).alias("slot"))


@query(f"""WITH {S.GPS}, s AS (SELECT floor((epoch_us(time) - epoch_us(TIMESTAMP '2024-01-01')) / 1800000000)::INT AS slot, count(*) AS n FROM gps WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-02-01' GROUP BY 1),
d AS (SELECT i AS slot, TIMESTAMP '2024-01-01' + to_minutes((i * 30)::INT) AS start FROM (SELECT unnest(generate_series(0, 1487))::INT AS i))
SELECT (isodow(start) - 1)::INT AS weekday, hour(start)::INT AS hour, isodow(start) >= 6 AS is_weekend, hour(start) >= 6 AND hour(start) < 18 AS is_day, count(*) AS n_slots, sum(coalesce(n, 0))::BIGINT AS n_points FROM d LEFT JOIN s ON d.slot = s.slot GROUP BY ALL""")
def tim_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = gps(spark, sf_dir).groupBy(temporal.slot(F.col("time"), "2024-01-01", "2024-02-01", 30).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    days = temporal.slots(spark, "2024-01-01", "2024-02-01", 30)
    return days.join(counted, "slot", "left").groupBy("weekday", "hour", "is_weekend", "is_day").agg(F.count(F.lit(1)).alias("n_slots"), F.sum(F.coalesce("n", F.lit(0))).alias("n_points"))


@query(f"""WITH {S.GPS}, a AS (SELECT *, count(*) OVER (PARTITION BY oid) AS n FROM gps), b AS (SELECT *, count(*) OVER (PARTITION BY oid) AS c FROM a
  WHERE n > 1 AND time >= TIMESTAMP '2024-01-03' AND time < TIMESTAMP '2024-01-28' AND lat >= 34.2::DOUBLE AND lat < 34.3::DOUBLE AND lng >= 108.9::DOUBLE AND lng < 109.0::DOUBLE)
SELECT oid, seq, time, lat, lng, oid::VARCHAR || '_' || strftime(min(time) OVER (PARTITION BY oid), '%Y%m%d%H%M') || '_' || strftime(max(time) OVER (PARTITION BY oid), '%Y%m%d%H%M') AS tid FROM b WHERE c > 1""")
def flt_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, w = T.range_filter(gps(spark, sf_dir), FILTER_BOX, START, END), T.whole()
    return p.withColumn("tid", T.trajectory_id(F.col("oid"), F.min("time").over(w), F.max("time").over(w), "yyyyMMddHHmm"))


@query(f"WITH {SPEED} SELECT oid, seq, time, lat, lng FROM clean")
def flt_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.speed_filter(gps(spark, sf_dir), 1.0).select("oid", "seq", "time", "lat", "lng")


def _segments_sql(breaks: str) -> str:
    return f"""WITH {S.GPS}, {S.steps()}, m AS (SELECT *, sum(CASE WHEN {breaks} THEN 1 ELSE 0 END) OVER (PARTITION BY oid ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment FROM steps),
c AS (SELECT *, count(*) OVER (PARTITION BY oid, segment) AS n FROM m) SELECT oid, seq, segment FROM c WHERE n > 1"""


@query(_segments_sql("epoch_us(time) - epoch_us(ptime) > 43200000000"))
def seg_time_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.time_gap_segments(gps(spark, sf_dir), 12 * 3600).select("oid", "seq", "segment")


@query(_segments_sql(f"{S.hav('plat', 'plng', 'lat', 'lng')} > 300"))
def seg_distance_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distance_gap_segments(gps(spark, sf_dir), 300.0).select("oid", "seq", "segment")


@query(f"""WITH {S.GPS}, {S.steps()},
m AS (SELECT *, sum(CASE WHEN {S.hav('plat', 'plng', 'lat', 'lng')} > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY oid ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment FROM steps),
l AS (SELECT *, lag(lat) OVER w AS y, lag(lng) OVER w AS x FROM m WINDOW w AS (PARTITION BY oid, segment ORDER BY time, seq)),
t AS (SELECT *, sum(CASE WHEN y IS NOT NULL THEN {S.hav('y', 'x', 'lat', 'lng')} END) OVER (PARTITION BY oid, segment) AS total FROM l) SELECT oid, seq, segment FROM t WHERE total > 200""")
def seg_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories cut at jumps of more than 300 m, of which those longer than 200 m stay."""
    return T.spaced_trajectories(gps(spark, sf_dir), 300.0, 200.0).select("oid", "seq", "segment")


_LINE = f"""(SELECT q.oid, q.week, q.lo, q.hi, p.k, p.lat, p.lng, a.lat AS y1, a.lng AS x1, b.lat AS y2, b.lng AS x2 FROM cut q JOIN pts p ON p.oid = q.oid AND p.week = q.week AND p.k > q.lo AND p.k < q.hi
  JOIN pts a ON a.oid = q.oid AND a.week = q.week AND a.k = q.lo JOIN pts b ON b.oid = q.oid AND b.week = q.week AND b.k = q.hi WHERE q.hi - q.lo >= 4)"""
_RATE = f"CASE WHEN {S.hav('y1', 'x1', 'y2', 'x2')} = 0 THEN 0 ELSE {S.hav('y1', 'x1', 'lat', 'lng')} * cos(radians({S.brg('y1', 'x1', 'lat', 'lng')} - {S.brg('y1', 'x1', 'y2', 'x2')})) / {S.hav('y1', 'x1', 'y2', 'x2')} END"


@query(f"""WITH RECURSIVE {S.GPS},
pts AS (SELECT *, row_number() OVER (PARTITION BY oid, week ORDER BY time, seq) - 1 AS k FROM (SELECT *, (epoch_us(time) // 604800000000)::BIGINT AS week FROM gps)),
cut AS (SELECT oid, week, 0::BIGINT AS lo, max(k) AS hi FROM pts GROUP BY oid, week
  UNION ALL SELECT oid, week, unnest([lo, far]), unnest([far, hi]) FROM (
    SELECT oid, week, lo, hi, arg_max(k, (off, -k)) AS far, max(off) AS most FROM (
      SELECT oid, week, lo, hi, k, {S.hav('lat', 'lng', 'y1 + rate * (y2 - y1)', 'x1 + rate * (x2 - x1)')} AS off FROM (SELECT *, {_RATE} AS rate FROM {_LINE})) GROUP BY oid, week, lo, hi) WHERE most >= 150),
kept AS (SELECT oid, week, lo AS k FROM cut UNION SELECT oid, week, hi FROM cut UNION SELECT oid, week, unnest(generate_series(lo, hi)) FROM cut WHERE hi - lo < 4)
SELECT oid, week, count(*) AS n, round(sum(lat), 6) AS lats, round(sum(lng), 6) AS lngs FROM kept JOIN pts USING (oid, week, k) GROUP BY oid, week""")
def trj_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's week as a line, without the points less than 150 m off."""
    p = gps(spark, sf_dir).groupBy("oid", F.floor(F.unix_micros("time") / 604_800_000_000).alias("week")).agg(F.array_sort(F.collect_list(F.struct("time", "seq", "lat", "lng"))).alias("coords"))
    bent = raster.simplify_coords(p.withColumn("coords", F.transform("coords", lambda q: F.struct(q["lat"].alias("lat"), q["lng"].alias("lng")))), 150.0)
    total = lambda c: r(F.aggregate("coords", F.lit(0.0), lambda s, q: s + q[c]))
    return bent.select("oid", "week", F.size("coords").cast("long").alias("n"), total("lat").alias("lats"), total("lng").alias("lngs"))


BEYOND = """pts AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY time, seq) - 1 AS k, count(*) OVER (PARTITION BY oid) AS n FROM gps),
nxt AS (SELECT a.oid, a.k, a.n, a.time, coalesce(min(b.k), a.n) AS nx FROM pts a LEFT JOIN pts b ON a.oid = b.oid AND b.k > a.k AND {far} GROUP BY a.oid, a.k, a.n, a.time),
scan AS (SELECT x.oid, x.k, x.n, x.nx, epoch_us(l.time) - epoch_us(x.time) > {stay} AS stay FROM nxt x JOIN pts l ON l.oid = x.oid AND l.k = x.nx - 1)"""


def _beyond(dist: int, hours: int) -> str:
    return BEYOND.format(far=f"{S.hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} > {dist}", stay=f"{hours}::BIGINT * 3600 * 1000000")


@query(f"WITH {S.GPS}, {_beyond(300, 12)} SELECT oid, k::INT AS idx, nx::INT AS next_idx, stay AS is_stay FROM scan")
def sty_first_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_beyond(gps(spark, sf_dir), 300.0, 12 * 3600)


_JUMPS = "go AS (SELECT oid, k, n, nx, stay FROM scan WHERE k = 0 AND n > 1 UNION ALL SELECT s.oid, s.k, s.n, s.nx, s.stay FROM go g JOIN scan s ON s.oid = g.oid AND s.k = CASE WHEN g.stay THEN g.nx ELSE g.k + 1 END WHERE s.k < s.n - 1)"


@query(f"""WITH RECURSIVE {S.GPS}, {_beyond(300, 12)}, {_JUMPS}, st AS (SELECT oid, k, nx, row_number() OVER (PARTITION BY oid ORDER BY k) - 1 AS part FROM go WHERE stay)
SELECT p.oid, part::INT AS part, (p.k - st.k)::INT AS pos, p.time, p.seq, p.lat, p.lng FROM st JOIN pts p ON p.oid = st.oid AND p.k >= st.k AND p.k < st.nx""")
def sty_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.classic_stays(gps(spark, sf_dir), 300.0, 12 * 3600)


def travel_sql(dist: int, hours: int) -> str:
    """pts and pieces: what lies between the stays of gps."""
    return f"""{_beyond(dist, hours)}, {_JUMPS}, st AS (SELECT oid, k, nx, n FROM go WHERE stay),
bounds AS (SELECT oid, coalesce(lag(nx) OVER (PARTITION BY oid ORDER BY k), 0) AS lo, k AS hi, false AS tail FROM st
  UNION ALL SELECT a.oid, coalesce((SELECT max(nx) FROM st WHERE st.oid = a.oid), 0), a.n, true FROM (SELECT DISTINCT oid, n FROM pts WHERE n > 1) a),
pieces AS (SELECT oid, lo, hi, row_number() OVER (PARTITION BY oid ORDER BY lo, hi) - 1 AS part FROM bounds WHERE lo < hi - 2)"""


@query(f"""WITH RECURSIVE {S.GPS}, {travel_sql(300, 12)}
SELECT p.oid, part::INT AS part, (p.k - lo)::INT AS pos, p.time, p.seq, p.lat, p.lng FROM pieces b JOIN pts p ON p.oid = b.oid AND p.k >= lo AND p.k < hi""")
def seg_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stay_segments(gps(spark, sf_dir), 300.0, 12 * 3600)


@query(f"""WITH RECURSIVE {S.GPS}, {_beyond(300, 12)},
w AS (SELECT oid, k, n, CASE WHEN stay THEN nx ELSE -1 END AS far, CASE WHEN stay THEN k ELSE -1 END AS start, stay AND nx <> k + 1 AS open, stay AND nx = k + 1 AS closed FROM scan WHERE k = 0 AND n > 1
  UNION ALL SELECT oid, k, n, far, start, held AND k <> far - 1, held AND k = far - 1 FROM (
    SELECT s.oid, s.k, s.n, CASE WHEN w.far < s.nx AND s.stay THEN s.nx ELSE w.far END AS far, CASE WHEN w.far < s.nx AND s.stay AND NOT w.open THEN s.k ELSE w.start END AS start, w.open OR (w.far < s.nx AND s.stay) AS held
    FROM w JOIN scan s ON s.oid = w.oid AND s.k = w.k + 1 WHERE s.k < s.n - 1)),
st AS (SELECT oid, start, far, row_number() OVER (PARTITION BY oid ORDER BY k) - 1 AS part FROM w WHERE closed)
SELECT p.oid, part::INT AS part, (p.k - st.start)::INT AS pos, p.time, p.seq, p.lat, p.lng FROM st JOIN pts p ON p.oid = st.oid AND p.k >= st.start AND p.k < st.far""")
def sty_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.density_stays(gps(spark, sf_dir), 300.0, 12 * 3600)


@query(f"""WITH RECURSIVE {S.GPS}, {_beyond(300, 12)}, {_JUMPS}, st AS (SELECT oid, k, nx FROM go WHERE stay),
v AS (SELECT st.oid, st.k, min(time) AS a, max(time) AS z, avg(lat) AS y, avg(lng) AS x FROM st JOIN pts p ON p.oid = st.oid AND p.k >= st.k AND p.k < st.nx GROUP BY st.oid, st.k)
SELECT oid, a AS start, z AS "end", round(y, 7) AS lat, round(x, 7) AS lng FROM v WHERE (epoch_us(a) + epoch_us(z)) // 2 >= epoch_us(TIMESTAMP '2024-01-05') AND (epoch_us(a) + epoch_us(z)) // 2 < epoch_us(TIMESTAMP '2024-01-25')
 AND {S.hav('y', 'x', '34.24::DOUBLE', '108.95::DOUBLE')} <= 3000""")
def sty_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays whose middle lies in a time window and whose centroid lies within 3 km."""
    s = T.classic_stays(gps(spark, sf_dir), 300.0, 12 * 3600).groupBy("oid", "part").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    window = [F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-25")]
    near = geo.within_m(F.col("lat"), F.col("lng"), 34.24, 108.95, 3000.0)
    return s.where(temporal.temporal_valid(F.col("start"), F.col("end"), *window) & near).select("oid", "start", "end", r("lat", 7).alias("lat"), r("lng", 7).alias("lng"))


@query(f"""WITH {S.GPS}, {S.steps()}, m AS (SELECT oid, count(*) AS n, min(time) AS start, max(time) AS "end", round(coalesce(sum(d), 0), 4) AS length_m, round(avg(dt), 4) AS mean_dt, round(avg(d), 4) AS mean_dist, round(avg(lat), 8) AS c_lat, round(avg(lng), 8) AS c_lng,
  round((epoch_us(max(time)) - epoch_us(min(time))) / 1e6, 4) AS duration_s FROM (SELECT *, CASE WHEN k > 1 THEN {S.hav('plat', 'plng', 'lat', 'lng')} END AS d, (epoch_us(time) - epoch_us(ptime)) / 1e6 AS dt FROM steps) GROUP BY oid)
SELECT *, oid::VARCHAR || '_' || strftime(start, '%Y%m%d%H%M%S') || '_' || strftime("end", '%Y%m%d%H%M%S') AS tid FROM m""")
def trj_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.measures(gps(spark, sf_dir))
    return m.select("oid", "n", "start", "end", *[r(c, 4).alias(c) for c in ("length_m", "mean_dt", "mean_dist")], r("c_lat", 8).alias("c_lat"), r("c_lng", 8).alias("c_lng"), r("duration_s", 4).alias("duration_s"), T.trajectory_id(F.col("oid"), F.col("start"), F.col("end")).alias("tid"))


@query(f"""WITH {S.GPS} SELECT oid, count(*) AS n, round(min({S.hav('lat', 'lng', '34.24::DOUBLE', '108.95::DOUBLE')}), 4) AS nearest_m, round({S.hav('avg(lat)', 'avg(lng)', '34.24::DOUBLE', '108.95::DOUBLE')}, 4) AS centroid_m FROM gps
WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-20' GROUP BY oid""")
def trj_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.slice_time(gps(spark, sf_dir), "2024-01-10", "2024-01-20")
    g = p.groupBy("oid").agg(F.count(F.lit(1)).alias("n"), F.min(geo.haversine_m(F.col("lat"), F.col("lng"), 34.24, 108.95)).alias("nearest_m"), F.avg("lat").alias("y"), F.avg("lng").alias("x"))
    return g.select("oid", "n", r("nearest_m", 4).alias("nearest_m"), r(geo.haversine_m(F.col("y"), F.col("x"), 34.24, 108.95), 4).alias("centroid_m"))


@query(f"""WITH {S.GPS}, q AS (SELECT oid, unnest(generate_series(1, 30)) AS d FROM (SELECT DISTINCT oid FROM gps)), a AS (SELECT oid, TIMESTAMP '2024-01-01' + to_days(d::INT) AS qt FROM q),
s AS (SELECT *, lead(time) OVER w AS nt, lead(lat) OVER w AS nlat, lead(lng) OVER w AS nlng FROM gps WINDOW w AS (PARTITION BY oid ORDER BY time, seq))
SELECT a.oid, a.qt AS asked, round(lat + (epoch_us(qt) - epoch_us(time)) / (epoch_us(nt) - epoch_us(time)) * (nlat - lat), 8) AS lat, round(lng + (epoch_us(qt) - epoch_us(time)) / (epoch_us(nt) - epoch_us(time)) * (nlng - lng), 8) AS lng
FROM a LEFT JOIN s ON a.oid = s.oid AND qt >= time AND qt < nt""")
def trj_position_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gps(spark, sf_dir)
    days = F.explode(F.sequence(F.lit(1), F.lit(30)))
    asked = p.select("oid").distinct().select("oid", days.alias("d")).select("oid", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("d"))).alias("at"))
    return T.position_at(p, asked).select("oid", F.col("at").alias("asked"), r("lat", 8).alias("lat"), r("lng", 8).alias("lng"))


@query(_segments_sql("epoch_us(time) - epoch_us(ptime) > 43200000000").replace("SELECT oid, seq, segment FROM c WHERE n > 1", "SELECT (SELECT count(DISTINCT oid) FROM c WHERE n > 1) AS n_objects, (SELECT count(*) FROM c WHERE n > 1) AS n_points, (SELECT count(*) FROM (SELECT DISTINCT oid, segment FROM c)) AS n_trajectories"))
def agg_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and points of trajectories of two points or more, and all trajectories."""
    w = T.ordered()
    marked = T.with_previous(gps(spark, sf_dir)).withColumn("segment", F.sum(F.when(F.col("dt") > 12 * 3600, 1).otherwise(0)).over(w))
    per = marked.groupBy("oid", "segment").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.countDistinct(F.when(F.col("n") > 1, F.col("oid"))).alias("n_objects"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_points"), F.count(F.lit(1)).alias("n_trajectories"))


def _histogram_sql(value: str, bins: int) -> str:
    return f"""WITH {S.GPS}, {S.steps()}, v AS (SELECT oid, {value} AS v FROM (SELECT *, {S.hav('plat', 'plng', 'lat', 'lng')} AS d, (epoch_us(time) - epoch_us(ptime)) / 1e6 AS dt FROM steps) GROUP BY oid),
e AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, count(v) AS total FROM v), b AS (SELECT least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})::INT AS bin, lo, hi, total FROM v, e WHERE v IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS high, round(count(*) / any_value(total), 9) AS share FROM b GROUP BY bin, lo, hi"""


def _histogram(spark, sf_dir, column: str, bins: int) -> DataFrame:
    h = T.histogram(T.measures(gps(spark, sf_dir)), column, bins)
    return h.select("bin", r("low").alias("low"), r("high").alias("high"), r("share", 9).alias("share"))


@query(_histogram_sql("count(*)", 10))
def agg_points_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, "n", 10)


@query(_histogram_sql("round(avg(dt), 3)", 10))
def agg_interval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.histogram(T.measures(gps(spark, sf_dir)).withColumn("v", F.round("mean_dt", 3)), "v", 10)
    return h.select("bin", r("low").alias("low"), r("high").alias("high"), r("share", 9).alias("share"))


@query(_histogram_sql("round(sum(CASE WHEN k > 1 THEN d END), 3)", 50))
def agg_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.histogram(T.measures(gps(spark, sf_dir)).withColumn("v", F.round("length_m", 3)), "v", 50)
    return h.select("bin", r("low").alias("low"), r("high").alias("high"), r("share", 9).alias("share"))


@query(_histogram_sql("round((epoch_us(max(time)) - epoch_us(min(time))) / 6e7, 3)", 10))
def agg_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes."""
    h = T.histogram(T.measures(gps(spark, sf_dir)).withColumn("v", F.round(F.col("duration_s") / 60, 3)), "v", 10)
    return h.select("bin", r("low").alias("low"), r("high").alias("high"), r("share", 9).alias("share"))


@query(_histogram_sql("round(avg(CASE WHEN k > 1 THEN d END), 3)", 10))
def agg_spacing_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.histogram(T.measures(gps(spark, sf_dir)).withColumn("v", F.round("mean_dist", 3)), "v", 10)
    return h.select("bin", r("low").alias("low"), r("high").alias("high"), r("share", 9).alias("share"))


@query(f"""WITH {S.GPS}, {S.steps()}, m AS (SELECT oid, count(*) AS n, coalesce(sum(CASE WHEN k > 1 THEN {S.hav('plat', 'plng', 'lat', 'lng', '6371000')} END), 0) AS len, (epoch_us(max(time)) - epoch_us(min(time))) / 1e6 AS dur FROM steps GROUP BY oid)
SELECT oid, n, round(len, 4) AS length_m, round(dur / 60, 6) AS minutes, round(dur / (n - 1), 4) AS mean_dt, round(len / (n - 1), 4) AS mean_dist FROM m WHERE n > 1""")
def agg_csv_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of lines without times of their own: points evenly spread in time, the earth's radius 6371000 m."""
    m = T.uniform_measures(gps(spark, sf_dir))
    return m.select("oid", "n", r("length_m", 4).alias("length_m"), r(F.col("duration_s") / 60, 6).alias("minutes"), r("mean_dt", 4).alias("mean_dt"), r("mean_dist", 4).alias("mean_dist"))


@query(f"""WITH {S.GPS}, b AS (SELECT oid, min(time) AS a, max(time) AS z FROM gps WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-20' GROUP BY oid),
s AS (SELECT oid, floor((epoch_us(a) - epoch_us(TIMESTAMP '2024-01-05')) / 1800000000)::INT AS lo, floor((epoch_us(z) - epoch_us(TIMESTAMP '2024-01-05')) / 1800000000)::INT AS hi FROM b)
SELECT oid, lo, hi, hi - lo + 1 AS n FROM s""")
def tim_slot_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-hour slots that each object's points within two weeks span."""
    span = ("2024-01-05", "2024-01-20")
    b = T.slice_time(gps(spark, sf_dir), *span).groupBy("oid").agg(F.min("time").alias("a"), F.max("time").alias("z"))
    return b.select("oid", temporal.slot_range(F.col("a"), F.col("z"), *span, 30).alias("s")).select("oid", F.element_at("s", 1).alias("lo"), F.element_at("s", -1).alias("hi"), F.size("s").alias("n"))


@query(f"""WITH {S.GPS}, k AS (SELECT *, floor((own - 34.206385::DOUBLE) / {_DLAT!r}::DOUBLE) AS i, floor((lng - 108.917423::DOUBLE) / {_DLNG!r}::DOUBLE) AS j FROM (SELECT *, CASE WHEN lat < 34.279658 AND lng < 108.99286 THEN lat END AS own FROM gps))
SELECT oid, seq, (i * {_COLUMNS} + j)::BIGINT AS region, round(34.206385::DOUBLE + i * {_DLAT!r}::DOUBLE, 7) AS min_lat, round(34.206385::DOUBLE + (i + 1) * {_DLAT!r}::DOUBLE, 7) AS max_lat, round(own, 7) AS lat, CASE WHEN own IS NOT NULL THEN round(lng, 7) END AS lng FROM k""")
def geo_regions_south(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions counted from the south, and points through the pixels of their region and back; none for places outside."""
    lat, lng = F.col("lat"), F.col("lng")
    own = F.when((lat < BOX[2]) & (lng < BOX[3]), lat)
    p = gps(spark, sf_dir).withColumn("region", (F.floor((own - BOX[0]) / _DLAT) * _COLUMNS + F.floor((lng - BOX[1]) / _DLNG)).cast("long"))
    p = p.withColumn("b", geo.region_box(F.col("region"), BOX, 400, origin="sw"))
    y, x = geo.rc_to_geo(*geo.geo_to_rc(lat, lng, F.col("b"), 400), F.col("b"), 400)
    return p.select("oid", "seq", "region", r("b.min_lat", 8).alias("min_lat"), r("b.max_lat", 8).alias("max_lat"), r(y, 7).alias("lat"), r(x, 7).alias("lng"))


@query(f"""WITH {SPEED}, s AS (SELECT *, lag(time) OVER (PARTITION BY oid ORDER BY time, seq) AS pt FROM clean),
m AS (SELECT *, sum(CASE WHEN epoch_us(time) - epoch_us(pt) > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY oid ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM s)
SELECT oid, segment::BIGINT AS segment, count(*) AS n, min(time) AS start, max(time) AS "end" FROM m GROUP BY oid, segment HAVING count(*) > 1""")
def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed filter, then time-gap segmentation: the cleaning job."""
    p = gps(spark, sf_dir).transform(T.speed_filter, 1.0).transform(T.time_gap_segments, 12 * 3600)
    return p.groupBy("oid", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("start"), F.max("time").alias("end"))
