"""Queries on rasters, network conflation and map quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import evaluation as E
from ..operators import fusion, network, raster, spatial
from ..sources import fixtures as X
from ..sources.scratch import scratch_path
from ..sources.tables import stored
from . import sql as S
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


PIXELS = "px AS (SELECT vec_id, k, (4 * (vec_id // 25) + k // 8)::INT AS y, (4 * (vec_id % 25) + k % 8)::INT AS x, CASE WHEN embedding[k + 1] > 0 THEN 1 ELSE 0 END AS v FROM (SELECT vec_id, embedding, unnest(generate_series(0, 63)) AS k FROM embeddings))"
CANVAS = PIXELS + ", canvas AS (SELECT DISTINCT y, x FROM px WHERE v = 1)"


def _canvas(spark, sf_dir) -> DataFrame:
    return raster.stitch(raster.to_pixels(X.patches(spark, sf_dir), 8))


@query(f"WITH {PIXELS} SELECT y, x, max(v)::INT AS v FROM px WHERE v <> 0 GROUP BY y, x")
def ras_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canvas(spark, sf_dir)


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v::DOUBLE > 0.1::DOUBLE THEN 255 ELSE 0 END), ',') AS bits FROM embeddings")
def ras_binarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.patches(spark, sf_dir).select("vec_id", F.array_join(raster.binarise(F.col("data"), 0.1, 255), ",").alias("bits"))


CLOSED = CANVAS + """, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM canvas), o AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)),
wide AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM canvas, o, s WHERE y + dy >= 0 AND y + dy < h AND x + dx >= 0 AND x + dx < w),
v AS (SELECT y + dy AS y, x + dx AS x, count(*) AS n FROM wide, o GROUP BY 1, 2),
closed AS (SELECT y::INT AS y, x::INT AS x FROM v, s WHERE y >= 0 AND x >= 0 AND y < h AND x < w AND n = (CASE WHEN y = 0 OR y = h - 1 THEN 2 ELSE 3 END) * (CASE WHEN x = 0 OR x = w - 1 THEN 2 ELSE 3 END))"""


@query(f"WITH {CLOSED} SELECT y, x FROM closed")
def ras_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _canvas(spark, sf_dir)
    h, w = c.agg(F.max("y") + 1, F.max("x") + 1).first()
    return raster.close3(c, h or 1, w or 1)


@query(f"""WITH {PIXELS}, p AS (SELECT vec_id AS tile, y, x FROM px WHERE v = 1), n AS (SELECT a.tile, a.y, a.x, b.y AS ny, b.x AS nx FROM p a JOIN p b ON a.tile = b.tile AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x))
SELECT tile, y, x, ny, nx FROM n WHERE y = ny OR x = nx OR NOT EXISTS (SELECT 1 FROM p WHERE p.tile = n.tile AND ((p.y = n.ny AND p.x = n.x) OR (p.y = n.y AND p.x = n.nx)))""")
def ras_pixel_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster.to_pixels(X.patches(spark, sf_dir), 8).withColumnRenamed("vec_id", "tile")
    return raster.pixel_graph(p)


@query()
def ras_skeleton_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stitched canvas as simplified lines: objects under three pixels out, thinned and traced over all patches."""
    return raster.bent_lines(raster.skeleton_lines(_canvas(spark, sf_dir).select("y", "x"), least=3), 1.0)


@query("SELECT vec_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT vec_id, ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM embeddings)")
def ras_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.split_by_hash(X.patches(spark, sf_dir), "vec_id")


@query(f"""WITH {CANVAS}, e AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM canvas), t AS (SELECT DISTINCT y // 16 AS ty, x // 16 AS tx FROM canvas),
g AS (SELECT ty, tx, i, unnest(generate_series(0, 19)) AS j FROM (SELECT ty, tx, unnest(generate_series(0, 19)) AS i FROM t)),
m AS (SELECT ty, tx, i::INT AS i, j::INT AS j, greatest(least(round_even(ty * 16 + 0.25 + (i + 0.5) / 20 * 16 - 0.5, 0), h - 1), 0)::INT AS y, greatest(least(round_even(tx * 16 + 0.25 + (j + 0.5) / 20 * 16 - 0.5, 0), w - 1), 0)::INT AS x FROM g, e)
SELECT (ty * 100000 + tx)::BIGINT AS region, i, j, CASE WHEN c.y IS NULL THEN 0 ELSE 1 END AS v FROM m LEFT JOIN canvas c ON m.y = c.y AND m.x = c.x""")
def ras_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of 16 by 16 pixels of the canvas, a quarter pixel off, as 20 by 20."""
    c = _canvas(spark, sf_dir)
    h, w = c.agg(F.max("y") + 1, F.max("x") + 1).first()
    t = c.select(F.floor(F.col("y") / 16).alias("ty"), F.floor(F.col("x") / 16).alias("tx")).distinct()
    at = lambda k, more: (F.col(k) * 16 + 0.25 + more).cast("double")
    regions = t.select((F.col("ty") * 100000 + F.col("tx")).alias("region"), at("ty", 0).alias("y0"), at("ty", 16).alias("y1"), at("tx", 0).alias("x0"), at("tx", 16).alias("x1"))
    return raster.resample(c, regions, h or 1, w or 1, 20)


MERCATOR = (34.0, 100.0, 60.0, 110.0)


@query(f"""WITH {CANVAS},
e AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w, (max(y) + 16) // 16 AS rows, (max(x) + 16) // 16 AS cols FROM canvas),
t AS (SELECT *, unnest(generate_series(0, rows * cols - 1)) AS region FROM e),
b AS (SELECT *, 60::DOUBLE - (region // cols + 1)::DOUBLE * (26::DOUBLE / rows) AS lo, 60::DOUBLE - (region // cols)::DOUBLE * (26::DOUBLE / rows) AS hi,
  100::DOUBLE + (region % cols)::DOUBLE * (10::DOUBLE / cols) AS west, 100::DOUBLE + (region % cols + 1)::DOUBLE * (10::DOUBLE / cols) AS east FROM t),
g AS (SELECT *, unnest(generate_series(0, 19)) AS j FROM (SELECT *, unnest(generate_series(0, 19)) AS i FROM b)),
d AS (SELECT *, hi - i::DOUBLE / 20 * (hi - lo) AS lat, west + j::DOUBLE / 20 * (east - west) AS lng FROM g),
m AS (SELECT *, asinh(tan(radians(lat))) AS my, asinh(tan(radians(34::DOUBLE))) AS my0, asinh(tan(radians(60::DOUBLE))) AS my1 FROM d),
p AS (SELECT region, i, j, greatest(least(round_even((my1 - my) / (my1 - my0) * h, 0), h - 1), 0)::INT AS y, greatest(least(round_even((lng - 100) / 10 * w, 0), w - 1), 0)::INT AS x FROM m)
SELECT region::BIGINT AS region, i::INT AS i, j::INT AS j, CASE WHEN c.y IS NULL THEN 0 ELSE 1 END AS v FROM p LEFT JOIN canvas c ON p.y = c.y AND p.x = c.x""")
def ras_resample_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canvas as a Mercator map from 34 to 60 degrees, cut into about as many regions, even in degrees, as it has blocks of 16
    pixels, at 20 pixels each."""
    c = _canvas(spark, sf_dir)
    h, w = (n or 1 for n in c.agg(F.max("y") + 1, F.max("x") + 1).first())
    rows, cols = -(-h // 16), -(-w // 16)
    dlat, dlng = 26 / rows, 10 / cols
    i, j = F.floor(F.col("id") / cols).cast("double"), (F.col("id") % cols).cast("double")
    box = F.struct((60.0 - (i + 1) * dlat).alias("min_lat"), (60.0 - i * dlat).alias("max_lat"), (100.0 + j * dlng).alias("min_lng"), (100.0 + (j + 1) * dlng).alias("max_lng"))
    return raster.resample_mercator(c, MERCATOR, h, w, spark.range(rows * cols).select(F.col("id").alias("region"), box.alias("box")), 20)


@query(f"""WITH {CANVAS}, e AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM canvas), t AS (SELECT DISTINCT y // 12 AS ty, x // 12 AS tx FROM canvas),
b AS (SELECT (ty * 100000 + tx)::BIGINT AS region, greatest(ty * 12 - 3, 0) AS y0, least(ty * 12 + 14, h) AS y1, greatest(tx * 12 - 3, 0) AS x0, least(tx * 12 + 14, w) AS x1 FROM t, e),
g AS (SELECT *, unnest(generate_series(0, 9)) AS j FROM (SELECT *, unnest(generate_series(0, 9)) AS i FROM b)),
a AS (SELECT *, least(greatest((i + 0.5::DOUBLE) / 10 * (y1 - y0) - 0.5::DOUBLE, 0), y1 - y0 - 1) AS fy, least(greatest((j + 0.5::DOUBLE) / 10 * (x1 - x0) - 0.5::DOUBLE, 0), x1 - x0 - 1) AS fx FROM g),
n AS (SELECT region, i, j, sum(CASE WHEN c.y IS NULL THEN 0 ELSE (1 - abs(fy - (c.y - y0))) * (1 - abs(fx - (c.x - x0))) END) AS v
  FROM a LEFT JOIN canvas c ON abs(fy - (c.y - y0)) < 1 AND abs(fx - (c.x - x0)) < 1 AND c.y >= y0 AND c.y < y1 AND c.x >= x0 AND c.x < x1 GROUP BY region, i, j)
SELECT region, i::INT AS i, j::INT AS j, round(v, 6) AS v FROM n""")
def ras_crop_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 17 by 17 pixels around every block of 12 of the canvas, over its rim too, at 10 by 10."""
    c = _canvas(spark, sf_dir)
    h, w = (n or 1 for n in c.agg(F.max("y") + 1, F.max("x") + 1).first())
    t = c.select(F.floor(F.col("y") / 12).alias("ty"), F.floor(F.col("x") / 12).alias("tx")).distinct()
    at = lambda k, more: (F.col(k) * 12 + more).cast("int")
    regions = t.select((F.col("ty") * 100000 + F.col("tx")).alias("region"), at("ty", -3).alias("y0"), at("ty", 14).alias("y1"), at("tx", -3).alias("x0"), at("tx", 14).alias("x1"))
    return raster.crop_bilinear(c, regions, h, w, 10).select("region", "i", "j", r("v").alias("v"))


@query(f"""WITH RECURSIVE {CLOSED}, told AS (SELECT * FROM (VALUES (0, 0, 256), (1, 0, 1), (1, -1, 2), (0, -1, 4), (-1, -1, 8), (-1, 0, 16), (-1, 1, 32), (0, 1, 64), (1, 1, 128)) r(ry, rx, bit)),
t AS (SELECT 0 AS k, y, x FROM closed UNION ALL
 SELECT k + 1, y, x FROM (SELECT k, y, x, m - 256 AS m, ((m - 256) >> 1) | ((m & 1) << 7) AS next FROM (SELECT k, (y + ry)::INT AS y, (x + rx)::INT AS x, sum(bit)::BIGINT AS m FROM t, told GROUP BY ALL) WHERE m >= 256), s
 WHERE k < 2 * (h + w) AND NOT (bit_count(m) BETWEEN 2 AND 6 AND bit_count(next & (255 - m)) = 1
  AND CASE WHEN k % 2 = 0 THEN (m & 21) <> 21 AND (m & 84) <> 84 ELSE (m & 69) <> 69 AND (m & 81) <> 81 END))
SELECT y, x FROM t WHERE k = (SELECT max(k) FROM t)""")
def ras_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stitched and closed canvas thinned as a whole."""
    return raster.thin_pixels(ras_close(spark, sf_dir))


@query("""WITH b AS (SELECT a.vec_id, list_sum(list_transform(generate_series(1, 64), lambda k: CASE WHEN a.embedding[k] > 0 AND b.embedding[k] > 0 THEN 1 ELSE 0 END))::DOUBLE AS m, list_sum(list_transform(a.embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END))::DOUBLE AS p, list_sum(list_transform(b.embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END))::DOUBLE AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(CASE WHEN m = 0 THEN 0 ELSE m / p END, 9) AS p, round(CASE WHEN m = 0 THEN 0 ELSE m / t END, 9) AS r, round(CASE WHEN m = 0 THEN 0 ELSE 2 * m / (p + t) END, 9) AS f1, round(CASE WHEN m = 0 THEN 0 ELSE m / (p + t - m) END, 9) AS iou, round(1 - (2 * m + 1) / (p + t + 1), 9) AS dice FROM b""")
def agg_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.patches(spark, sf_dir).select("vec_id", F.transform("pixels", lambda v: v.cast("double")).alias("a"))
    both = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    s = both.select("vec_id", raster.overlap_scores(F.col("a"), F.col("b")).alias("s"), raster.dice_loss(F.col("a"), F.col("b")).alias("dice"))
    return s.select("vec_id", *[r(f"s.{c}", 9).alias(c) for c in ("p", "r", "f1", "iou")], r("dice", 9).alias("dice"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: 1 / (1 + exp(-v::DOUBLE))) AS p FROM embeddings)
SELECT a.vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda k: -((CASE WHEN b.embedding[k] > 0 THEN 1 ELSE 0 END) * ln(greatest(p[k], 1e-8)) + (CASE WHEN b.embedding[k] > 0 THEN 0 ELSE 1 END) * ln(greatest(1 - p[k], 1e-8))))) / 64, 7) AS bce FROM e a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def agg_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.patches(spark, sf_dir)
    a = p.select("vec_id", F.transform("data", lambda v: 1 / (1 + F.exp(-v))).alias("a"))
    b = p.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("pixels", lambda v: v.cast("double")).alias("b"))
    return a.join(b, "vec_id").select("vec_id", r(raster.bce_loss(F.col("a"), F.col("b")), 7).alias("bce"))


@query("""WITH RECURSIVE s AS (SELECT label AS run, (row_number() OVER (PARTITION BY label ORDER BY vec_id))::INT AS epoch, round(embedding[1]::DOUBLE, 1) AS f1 FROM embeddings),
w AS (SELECT run, epoch, f1, f1 AS best, 0 AS counter FROM s WHERE epoch = 1 UNION ALL SELECT s.run, s.epoch, s.f1, greatest(w.best, s.f1), CASE WHEN s.f1 > w.best THEN 0 WHEN s.f1 < w.best THEN w.counter + 1 ELSE w.counter END FROM w JOIN s ON s.run = w.run AND s.epoch = w.epoch + 1)
SELECT run, epoch, f1, best, counter, counter >= 5 AS stopped FROM w""")
def agg_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by label, epochs by vector, scores by the first component to one digit: ties occur."""
    from pyspark.sql import Window

    e = X.table(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("epoch"), F.round(F.element_at("embedding", 1).cast("double"), 1).alias("f1"))
    return E.early_stopping(e, 5)


def _scores(spark, sf_dir) -> DataFrame:
    e = X.trail_edges(spark, sf_dir)
    g = e.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("eid") % 10 >= 3).cast("long")).alias("kept"), F.sum((F.col("eid") % 7 > 0).cast("long")).alias("found"))
    return g.select("region", (F.col("kept") / F.col("n")).alias("precision"), F.when(F.col("region") % 9 > 0, F.col("found") / F.col("n")).otherwise(F.lit(float("nan"))).alias("recall"))


@query(f"""WITH {TRAILS}, g AS (SELECT region, sum(CASE WHEN eid % 10 >= 3 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS p, sum(CASE WHEN eid % 7 > 0 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS r FROM te GROUP BY region),
m AS (SELECT region % 5 AS part, avg(p) FILTER (region % 9 > 0 AND p + r > 0) AS p, avg(r) FILTER (region % 9 > 0 AND p + r > 0) AS r, count(*) FILTER (region % 9 > 0 AND p + r > 0) AS evaluated, count(*) FILTER (region % 9 = 0 OR p + r <= 0) AS skipped FROM g GROUP BY 1)
SELECT part, round(p, 9) AS precision, round(r, 9) AS recall, evaluated, skipped, round(2 * p * r / (p + r), 9) AS f1 FROM m""")
def agg_topo_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro scores by part; every ninth region has no recall and is skipped."""
    s = E.macro_f1(_scores(spark, sf_dir).withColumn("part", F.col("region") % 5), ["part"])
    return s.select("part", r("precision", 9).alias("precision"), r("recall", 9).alias("recall"), "evaluated", "skipped", r("f1", 9).alias("f1"))


def _halves(spark, sf_dir):
    e = stored(X.trail_edges(spark, sf_dir), "trails")
    return e.where("eid % 10 >= 3"), e


@query(f"""WITH {TRAILS}, n AS (SELECT DISTINCT region, node, 34.2::DOUBLE + ((node // 100000)::DOUBLE + 0.5::DOUBLE) * 0.0004::DOUBLE AS lat, 108.9::DOUBLE + ((node % 100000)::DOUBLE + 0.5::DOUBLE) * 0.0004::DOUBLE AS lng FROM tb),
d AS (SELECT n.region, node, lat, lng, eid, y1, x1, y2, x2, greatest(0::DOUBLE, least(1::DOUBLE, {S.hav('y1', 'x1', 'lat', 'lng')} * cos(radians({S.brg('y1', 'x1', 'lat', 'lng')} - {S.brg('y1', 'x1', 'y2', 'x2')})) / {S.hav('y1', 'x1', 'y2', 'x2')})) AS rate FROM n JOIN te ON te.region = n.region AND eid % 10 >= 3),
f AS (SELECT *, {S.hav('lat', 'lng', 'CASE WHEN rate >= 1 THEN y2 WHEN rate <= 0 THEN y1 ELSE y1 + rate * (y2 - y1) END', 'CASE WHEN rate >= 1 THEN x2 WHEN rate <= 0 THEN x1 ELSE x1 + rate * (x2 - x1) END')} AS dist FROM d)
SELECT region, node, count(*) AS n_near, round(min(dist), 3) AS dist FROM f WHERE dist < 32 GROUP BY region, node""")
def fus_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base edges within 32 m of each node of the inferred network."""
    base, every = _halves(spark, sf_dir)
    c = fusion.closest_projection(X.trail_nodes(every), ["region", "node"], base, 32.0, every=True)
    return c.groupBy("region", "node").agg(F.count(F.lit(1)).alias("n_near"), r(F.min("dist"), 3).alias("dist"))


def _off(y1, x1, y2, x2, lat, lng) -> str:
    """Metres from a point to a segment."""
    rate = f"({S.hav(y1, x1, lat, lng)} * cos(radians({S.brg(y1, x1, lat, lng)} - {S.brg(y1, x1, y2, x2)})) / {S.hav(y1, x1, y2, x2)})"
    at = lambda a, b: f"(CASE WHEN {rate} >= 1 THEN {b} WHEN {rate} <= 0 THEN {a} ELSE {a} + {rate} * ({b} - {a}) END)"
    return S.hav(lat, lng, at(y1, y2), at(x1, x2))


@query(f"""WITH {TRAILS},
asks AS (SELECT region, v AS node, u AS other, y2 AS lat, x2 AS lng, y1 AS olat, x1 AS olng FROM te UNION ALL SELECT region, u, v, y1, x1, y2, x2 FROM te),
nodes AS (SELECT DISTINCT region, node, lat, lng FROM asks),
cand AS (SELECT n.region, node, eid, y1, x1, y2, x2 FROM nodes n JOIN te ON te.region = n.region AND eid % 10 >= 3 AND {_off('y1', 'x1', 'y2', 'x2', 'lat', 'lng')} < 60),
path AS (SELECT *, row_number() OVER (PARTITION BY region, trip ORDER BY time, seq) AS k FROM (SELECT oid AS region, (epoch_us(time) // 604800000000)::BIGINT AS trip, time, seq, lat, lng FROM gps)),
near AS (SELECT n.region, node, n.lat, n.lng, trip, k, {S.hav('n.lat', 'n.lng', 'p.lat', 'p.lng')} AS d FROM nodes n JOIN path p ON p.region = n.region),
best AS (SELECT region, node, lat, lng, trip, k AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY region, node, trip ORDER BY d, k) AS r FROM near WHERE d <= 45) WHERE r = 1),
ways AS (SELECT b.region, b.node, b.lat, b.lng, b.trip, max(n.k) FILTER (n.k < nearest) AS kc, min(n.k) FILTER (n.k > nearest) AS kw FROM best b JOIN near n ON n.region = b.region AND n.node = b.node AND n.trip = b.trip AND n.d > 45 GROUP BY ALL),
both_ AS (SELECT w.region, w.node, w.lat, w.lng, w.trip, c.lat AS cy, c.lng AS cx, g.lat AS gy, g.lng AS gx FROM ways w JOIN path c ON c.region = w.region AND c.trip = w.trip AND c.k = kc JOIN path g ON g.region = w.region AND g.trip = w.trip AND g.k = kw),
offs AS (SELECT b.*, other, {_off('b.lat', 'b.lng', 'olat', 'olng', 'cy', 'cx')} AS oc, {_off('b.lat', 'b.lng', 'olat', 'olng', 'gy', 'gx')} AS og FROM both_ b JOIN asks a ON a.region = b.region AND a.node = b.node),
turn AS (SELECT region, node, other, trip, CASE WHEN og < oc THEN cy ELSE gy END AS y, CASE WHEN og < oc THEN cx ELSE gx END AS x FROM offs WHERE (og < oc AND og < 40) OR (oc < og AND oc < 40)),
pick AS (SELECT t.region, t.node, other, trip, eid, {_off('y1', 'x1', 'y2', 'x2', 't.y', 't.x')} AS d FROM turn t JOIN cand c ON c.region = t.region AND c.node = t.node),
first AS (SELECT *, row_number() OVER (PARTITION BY region, node, other, trip ORDER BY d, eid) AS r FROM pick)
SELECT region, node, other, eid, count(*) AS n FROM first WHERE r = 1 AND d <= 40 GROUP BY region, node, other, eid""")
def fus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of weekly trips at both ends of every inferred edge for the base edges within 60 m."""
    base, every = _halves(spark, sf_dir)
    n = X.trail_nodes(every)
    at = lambda c, y, x: n.select("region", F.col("node").alias(c), F.col("lat").alias(y), F.col("lng").alias(x))
    ends = every.select("region", F.col("v").alias("node"), F.col("u").alias("other")).union(every.select("region", "u", "v"))
    asks = ends.join(at("node", "lat", "lng"), ["region", "node"]).join(at("other", "other_lat", "other_lng"), ["region", "other"])
    near = fusion.closest_projection(n, ["region", "node"], base, 60.0, every=True).select("region", "node", "eid").join(base.select("region", "eid", "coords"), ["region", "eid"])
    trips = X.gps(spark, sf_dir).select(F.col("oid").alias("region"), F.floor(F.unix_micros("time") / 604_800_000_000).alias("trip"), "time", "seq", "lat", "lng")
    return fusion.votes(asks, near, trips, 45.0, 40.0)


NODE_EDGES = f"""{TRAILS},
n AS (SELECT DISTINCT region, node, 34.2::DOUBLE + ((node // 100000)::DOUBLE + 0.5::DOUBLE) * 0.0004::DOUBLE AS lat, 108.9::DOUBLE + ((node % 100000)::DOUBLE + 0.5::DOUBLE) * 0.0004::DOUBLE AS lng FROM tb),
d AS (SELECT n.region, node, lat, lng, eid, y1, x1, y2, x2,
  greatest(0::DOUBLE, least(1::DOUBLE, {S.hav('y1', 'x1', 'lat', 'lng')} * cos(radians({S.brg('y1', 'x1', 'lat', 'lng')} - {S.brg('y1', 'x1', 'y2', 'x2')})) / {S.hav('y1', 'x1', 'y2', 'x2')})) AS rate
  FROM n JOIN te ON te.region = n.region AND eid % 10 >= 3),
at_ AS (SELECT *, CASE WHEN rate >= 1 THEN y2 WHEN rate <= 0 THEN y1 ELSE y1 + rate * (y2 - y1) END AS fy, CASE WHEN rate >= 1 THEN x2 WHEN rate <= 0 THEN x1 ELSE x1 + rate * (x2 - x1) END AS fx FROM d),
f AS (SELECT *, {S.hav('lat', 'lng', 'fy', 'fx')} AS dist FROM at_)"""


@query(f"""WITH {NODE_EDGES}, s AS (SELECT *, {S.hav('y1', 'x1', 'fy', 'fx')} <= 5 AS at1, {S.hav('y2', 'x2', 'fy', 'fx')} <= 5 AS at2 FROM f WHERE dist < 32)
SELECT region, node, eid, round(CASE WHEN at1 THEN y1 WHEN at2 THEN y2 ELSE fy END, 7) AS lat, round(CASE WHEN at1 THEN x1 WHEN at2 THEN x2 ELSE fx END, 7) AS lng FROM s""")
def fus_points_on_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each node of the inferred network is tied to the base edges near it; ends within 5 m take the place."""
    base, every = _halves(spark, sf_dir)
    near = fusion.closest_projection(X.trail_nodes(every), ["region", "node"], base, 32.0, every=True)
    met = near.join(base.select("region", "eid", "coords"), ["region", "eid"])
    p = met.withColumn("p", fusion.point_on_edge(F.col("coords"), F.col("segment"), F.col("rate"), 5.0))
    return p.select("region", "node", "eid", r("p.lat", 7).alias("lat"), r("p.lng", 7).alias("lng"))


@query(f"""WITH RECURSIVE {NODE_EDGES},
lv AS (SELECT n.region, n.node, min(dist) AS dist FROM n LEFT JOIN f ON f.region = n.region AND f.node = n.node GROUP BY n.region, n.node),
lk AS (SELECT region, u AS node, v AS other FROM te UNION SELECT region, v, u FROM te),
rc AS (SELECT region, node FROM lv WHERE dist IS NULL OR dist >= 32
  UNION SELECT lk.region, lk.other FROM rc JOIN lk ON lk.region = rc.region AND lk.node = rc.node JOIN lv o ON o.region = lk.region AND o.node = lk.other AND (o.dist IS NULL OR o.dist >= 10))
SELECT region, node FROM rc""")
def fus_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are new to the base network: the far ones, and what they reach over nodes that aren't close to it."""
    base, every = _halves(spark, sf_dir)
    n = X.trail_nodes(every)
    near = fusion.closest_projection(n, ["region", "node"], base, 32.0, every=True).groupBy("region", "node").agg(F.min("dist").alias("dist"))
    level = stored(n.join(near, ["region", "node"], "left").select("region", "node", "dist"), "levels")
    links = every.select("region", F.col("u").alias("node"), F.col("v").alias("other")).union(every.select("region", "v", "u"))
    return fusion.spread(level.where("dist is null").select("region", "node"), links, level.where("dist is null or dist >= 10"))


ROADS = """px AS (SELECT (4 * (vec_id // 25) + k // 8)::INT AS y, (4 * (vec_id % 25) + k % 8)::INT AS x, embedding[k + 1]::DOUBLE AS d FROM (SELECT vec_id, embedding, unnest(generate_series(0, 63)) AS k FROM embeddings)),
roads AS (SELECT DISTINCT y, x FROM px WHERE d > 0.2::DOUBLE)"""


def _roads(spark, sf_dir) -> DataFrame:
    """The stitched canvas of high values only: sparse enough for lines."""
    p = X.patches(spark, sf_dir).select("vec_id", "y", "x", raster.binarise(F.col("data"), 0.2).alias("pixels"))
    return raster.stitch(raster.to_pixels(p, 8)).select("y", "x")


@query(f"""WITH RECURSIVE {ROADS}, o AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)),
g AS (SELECT y AS sy, x AS sx, y, x FROM roads UNION SELECT g.sy, g.sx, c.y, c.x FROM g, o, roads c WHERE c.y = g.y + o.dy AND c.x = g.x + o.dx)
SELECT sy AS y, sx AS x FROM g GROUP BY sy, sx HAVING count(*) >= 4""")
def ras_drop_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canvas of high values without objects under four pixels."""
    return raster.drop_small_pixels(_roads(spark, sf_dir), 4)


@query()
def ras_mask_to_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stitched canvas of high values, closed, as a road network: small objects out, thinned, traced over all patches,
    simplified, placed."""
    c = _roads(spark, sf_dir)
    h, w = c.agg(F.max("y") + 1, F.max("x") + 1).first()
    e = raster.mask_to_network(raster.close3(c, h or 1, w or 1), 34.279658, 108.917423, 0.0001, least=4)
    return e.select("eid", "u", "v", F.size("coords").alias("n_points"), r("length", 3).alias("length"))


LAYERS = ("map", "trail", "building")


@query(f"""WITH px AS (SELECT (4 * (vec_id // 25) + k // 8)::INT AS y, (4 * (vec_id % 25) + k % 8)::INT AS x, embedding[k + 1] AS d FROM (SELECT vec_id, embedding, unnest(generate_series(0, 63)) AS k FROM embeddings)),
c AS (SELECT y, x, max((d > 0)::INT) AS map, max((d::DOUBLE > 0.1::DOUBLE)::INT) AS trail, max(CASE WHEN d::DOUBLE > 0.2::DOUBLE THEN 2 ELSE 0 END) AS building FROM px GROUP BY y, x),
e AS (SELECT max(y) FILTER (map + trail + building > 0) + 1 AS h, max(x) FILTER (map + trail + building > 0) + 1 AS w FROM c),
u AS (SELECT vec_id AS idx, CASE WHEN vec_id % 5 < 4 THEN 'train' ELSE 'val' END AS subset, ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT AS a, ('0x' || substr(md5('42:' || vec_id::VARCHAR), 9, 8))::BIGINT AS b FROM embeddings),
k AS (SELECT idx, subset, (a % (w - 4))::INT AS wx, (CASE WHEN subset = 'val' THEN h // 2 ELSE 0 END + b % (CASE WHEN subset = 'train' THEN greatest(0, h // 2 - 5) + 1 ELSE h - 5 - h // 2 + 1 END))::INT AS wy FROM u, e),
g AS (SELECT idx, subset, wx, wy, i, unnest(generate_series(0, 3)) AS j FROM (SELECT *, unnest(generate_series(0, 3)) AS i FROM k)),
v AS (SELECT idx, subset, wx, wy, i * 4 + j AS p, coalesce(map, 0) AS map, coalesce(trail, 0) AS trail, coalesce(building, 0) AS building FROM g LEFT JOIN c ON c.y = wy + i AND c.x = wx + j)
SELECT idx, subset, wx, wy, string_agg(map::VARCHAR, '' ORDER BY p) AS map, string_agg(trail::VARCHAR, '' ORDER BY p) AS trail,
 string_agg((CASE WHEN building = 2 THEN 0 ELSE trail END)::VARCHAR, '' ORDER BY p) AS masked FROM v GROUP BY idx, subset, wx, wy""")
def ras_random_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch data set: one random window of 4 by 4 pixels for each vector, three layers, written by subset and read again."""
    p = X.patches(spark, sf_dir).select("y", "x", F.posexplode("data").alias("k", "d"))
    at = [(F.col("y") + F.floor(F.col("k") / 8)).cast("int").alias("y"), (F.col("x") + F.col("k") % 8).cast("int").alias("x")]
    value = {"map": (F.col("d") > 0).cast("int"), "trail": (F.col("d") > 0.1).cast("int"), "building": F.when(F.col("d") > 0.2, 2).otherwise(0)}
    c = p.select(*at, F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), value[n].alias("v")) for n in LAYERS])).alias("s")).select("y", "x", "s.*")
    c = c.where("v <> 0").groupBy("layer", "y", "x").agg(F.max("v").alias("v"))
    h, w = c.agg(F.max("y") + 1, F.max("x") + 1).first()
    draws = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"))
    windows = raster.random_corners(draws, "idx", F.when(F.col("idx") % 5 < 4, "train").otherwise("val"), w, h, 4, split=0.5)
    path = scratch_path(spark, "patches")
    raster.cut_windows(c, windows, 4, list(LAYERS)).write.partitionBy("subset").parquet(path)
    text = lambda a: F.array_join(a, "")
    masked = raster.without_buildings(F.col("trail"), F.col("building"))
    return spark.read.parquet(path).select("idx", "subset", "wx", "wy", text("map").alias("map"), text("trail").alias("trail"), text(masked).alias("masked"))


TILE_M, TILE_PX = 800, 100
_DLAT, _DLNG, _ROWS, _COLUMNS = geo.region_grid(X.BOX, TILE_M)


@query(f"""WITH {S.GPS}, n AS (SELECT oid, (epoch_us(time) // 604800000000)::BIGINT AS week, lat, lng, row_number() OVER (PARTITION BY oid, epoch_us(time) // 604800000000 ORDER BY time, seq) AS k FROM gps),
c AS (SELECT oid, week, k, lat, lng, lead(lat) OVER w AS nlat, lead(lng) OVER w AS nlng, first(lat) OVER w AS flat, first(lng) OVER w AS flng, count(*) OVER (PARTITION BY oid, week) AS n FROM n WINDOW w AS (PARTITION BY oid, week ORDER BY k)),
b AS (SELECT oid, week, min(lat) AS y0, min(lng) AS x0, max(lat) AS y1, max(lng) AS x1 FROM c WHERE n > 2 GROUP BY oid, week),
t AS (SELECT id AS region, {X.BOX[2]!r}::DOUBLE - (id // {_COLUMNS} + 1)::DOUBLE * {_DLAT!r}::DOUBLE AS b0, {X.BOX[1]!r}::DOUBLE + (id % {_COLUMNS})::DOUBLE * {_DLNG!r}::DOUBLE AS b1, {X.BOX[2]!r}::DOUBLE - (id // {_COLUMNS})::DOUBLE * {_DLAT!r}::DOUBLE AS b2,
  {X.BOX[1]!r}::DOUBLE + (id % {_COLUMNS})::DOUBLE * {_DLNG!r}::DOUBLE + {_DLNG!r}::DOUBLE AS b3 FROM (SELECT unnest(generate_series(0, {_ROWS * _COLUMNS - 1})) AS id)),
m AS (SELECT * FROM t JOIN b ON b0 <= y1 AND y0 <= b2 AND b1 <= x1 AND x0 <= b3),
s AS (SELECT region, oid, week, (b2 - lat) / (b2 - b0) * {TILE_PX} AS y1, (lng - b1) / (b3 - b1) * {TILE_PX} AS x1, (b2 - coalesce(nlat, flat)) / (b2 - b0) * {TILE_PX} AS y2, (coalesce(nlng, flng) - b1) / (b3 - b1) * {TILE_PX} AS x2 FROM m JOIN c USING (oid, week)),
lh AS (SELECT region, oid, week, greatest(floor(min(y1)), 0)::INT AS lo, least(floor(max(y1)), {TILE_PX - 1})::INT AS hi FROM s GROUP BY region, oid, week),
rw AS (SELECT region, oid, week, unnest(generate_series(lo, hi)) AS y FROM lh),
cx AS (SELECT region, oid, week, y, x1 + (y + 0.5::DOUBLE - y1) / (y2 - y1) * (x2 - x1) AS spot FROM rw JOIN s USING (region, oid, week) WHERE (y1 <= y + 0.5::DOUBLE) <> (y2 <= y + 0.5::DOUBLE)),
px AS (SELECT region, oid, week, y, x FROM cx, (SELECT unnest(generate_series(0, {TILE_PX - 1})) AS x) g WHERE spot <= x + 0.5::DOUBLE GROUP BY region, oid, week, y, x HAVING count(*) % 2 = 1)
SELECT region, oid, week, count(*) AS n, sum(y)::BIGINT AS ys, sum(x)::BIGINT AS xs FROM px GROUP BY region, oid, week""")
def ras_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 800 m at 100 pixels with the polygons that meet them (the points of an object's week in order), filled."""
    p = X.gps(spark, sf_dir).withColumn("week", F.floor(F.unix_micros("time") / 604_800_000_000))
    ring = F.array_sort(F.collect_list(F.struct("time", "seq", "lat", "lng")))
    polygons = spatial.with_box(p.groupBy("oid", "week").agg(ring.alias("coords")).where("size(coords) > 2"))
    tiles = spark.range(_ROWS * _COLUMNS).select(F.col("id").alias("region"), geo.region_box(F.col("id"), X.BOX, TILE_M).alias("box"))
    tiles = tiles.select("region", "box", *[F.col(f"box.{c}").alias(b) for b, c in zip(("b0", "b1", "b2", "b3"), ("min_lat", "min_lng", "max_lat", "max_lng"), strict=True)])

    def corner(q):
        y, x = geo.geo_to_rc(q["lat"], q["lng"], F.col("box"), TILE_PX)
        return F.struct(y.alias("y"), x.alias("x"))

    met = spatial.box_join(tiles, polygons, levels=6).select("region", "oid", "week", F.transform("coords", corner).alias("ring"))
    return raster.fill_polygons(met, TILE_PX, TILE_PX).groupBy("region", "oid", "week").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ys"), F.sum("x").alias("xs"))


@query()
def fus_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, every = _halves(spark, sf_dir)
    trips = X.gps(spark, sf_dir).select(F.col("oid").alias("region"), F.floor(F.unix_seconds("time") / 604800).alias("trip"), "time", "seq", "lat", "lng")
    return fusion.fuse(base, every, trips, gap_m=150.0)


@query()
def eva_apls(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, every = _halves(spark, sf_dir)
    return E.apls(every, base, X.trail_nodes(every), 60.0)


@query()
def eva_topo(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, every = _halves(spark, sf_dir)
    return E.topo(every, base, X.trail_nodes(every), radius=300.0, step=60.0)


@query()
def eva_topo_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of TOPO results whose starts lie less than 120 m apart along the map the best stays, and those of precision 0.9 or more."""
    base, every = _halves(spark, sf_dir)
    return E.thin_results(E.topo(every, base, X.trail_nodes(every), radius=300.0, step=60.0), every, apart_m=120.0)
