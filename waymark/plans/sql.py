"""The fixtures and geometry of the queries in DuckDB SQL."""

from __future__ import annotations

GPS = """gps AS (SELECT user_id AS oid, event_id AS seq, ts AS time,
  34.206385::DOUBLE + (user_id * 37 % 50)::DOUBLE * 0.0012::DOUBLE
   + (CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END)::DOUBLE * 0.002::DOUBLE
   + (event_id * 7919 % 101)::DOUBLE * 0.000004::DOUBLE + CASE WHEN event_id % 41 = 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS lat,
  108.917423::DOUBLE + (user_id * 53 % 50)::DOUBLE * 0.0012::DOUBLE + (event_id * 104729 % 101)::DOUBLE * 0.000004::DOUBLE AS lng
  FROM events)"""
NODES = """nodes AS (SELECT node_id, 34.206385::DOUBLE + 0.0012::DOUBLE * (node_id // 50)::DOUBLE AS lat, 108.917423::DOUBLE + 0.0012::DOUBLE * (node_id % 50)::DOUBLE AS lng
  FROM (SELECT unnest(generate_series(0, 2899))::BIGINT AS node_id))"""
EDGES = NODES + """,
ends AS (SELECT node_id AS u, node_id + 1 AS v FROM nodes WHERE node_id % 50 < 49 UNION ALL SELECT node_id, node_id + 50 FROM nodes WHERE node_id < 2850),
edges AS (SELECT (row_number() OVER (ORDER BY u, v) - 1)::BIGINT AS eid, u, v, a.lat AS ulat, a.lng AS ulng, b.lat AS vlat, b.lng AS vlng
  FROM ends JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v)"""
#: Segments (eid, i, ends) of the edges: two where an edge has a middle vertex.
SEGMENTS = EDGES + """,
segs AS (SELECT eid, 0 AS i, ulat AS lat1, ulng AS lng1, CASE WHEN eid % 3 = 0 THEN (ulat + vlat) / 2 ELSE vlat END AS lat2, CASE WHEN eid % 3 = 0 THEN (ulng + vlng) / 2 ELSE vlng END AS lng2 FROM edges
  UNION ALL SELECT eid, 1, (ulat + vlat) / 2, (ulng + vlng) / 2, vlat, vlng FROM edges WHERE eid % 3 = 0)"""
PATHS = """paths AS (SELECT pid, pos, eid, ship + to_minutes(pos) AS enter_time, ship + to_minutes(pos + 1) AS leave_time FROM (
  SELECT l_orderkey AS pid, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1)::INT AS pos,
         l_partkey % 5692 AS eid, l_shipdate AS ship FROM lineitem))"""
ADJ = EDGES + """,
adj AS (SELECT (u // 50 // 10) * 5 + u % 50 // 10 AS region, eid, (9 - u // 50 % 10) * 40 AS r1, u % 50 % 10 * 40 AS c1, (9 - v // 50 % 10) * 40 AS r2, v % 50 % 10 * 40 AS c2,
   eid * 7919 % 10 >= 3 AS in_pred FROM edges WHERE (u // 50 // 10) * 5 + u % 50 // 10 = (v // 50 // 10) * 5 + v % 50 // 10)"""


def hav(lat1: str, lng1: str, lat2: str, lng2: str, radius: str = "6371008.7714") -> str:
    a = f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lng2}) - ({lng1})) / 2), 2))"
    return f"(CASE WHEN ({lat1}) = ({lat2}) AND ({lng1}) = ({lng2}) THEN 0::DOUBLE ELSE 2 * {radius}::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})) END)"


def brg(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    p, q, d = f"radians({lat1})", f"radians({lat2})", f"radians(({lng2}) - ({lng1}))"
    return f"((degrees(atan2(sin({d}) * cos({q}), cos({p}) * sin({q}) - sin({p}) * cos({q}) * cos({d}))) + 360) % 360)"


def steps(extra: str = "", keep: str = "gps") -> str:
    """Each point with the one before it on the same object."""
    w = "OVER (PARTITION BY oid ORDER BY time, seq)"
    return f"steps AS (SELECT *, lag(lat) {w} AS plat, lag(lng) {w} AS plng, lag(time) {w} AS ptime, row_number() {w} AS k{extra} FROM {keep})"
