"""The trajectory and map engine: registered queries against their SQL, micro cases by hand, kernels against brute force."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, temporal
from waymark.operators import evaluation, fusion, kernels, matching, network, raster, spatial
from waymark.operators import trajectory as T
from waymark.plans import registry
from waymark.sources import text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, (float, np.floating)):
        return "nan" if math.isnan(v) else f"{v:.8g}" if v else "0"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, db, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = db.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    mine = sorted(tuple(_plain(v) for v in row) for row in df.select(*columns).collect())
    assert mine == sorted(tuple(_plain(row[i]) for i in place) for row in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def _points(spark, rows):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    return spark.createDataFrame([(o, i, base + dt.timedelta(seconds=s), float(y), float(x)) for i, (o, s, y, x) in enumerate(rows)], "oid long, seq long, time timestamp, lat double, lng double")


M = 1 / 111_195.0797  # degrees of latitude in a metre


def test_distances_by_hand(spark):
    row = spark.range(1).select(geo.haversine_m(1.0, 2.0, 1.0, 2.0).alias("zero"), geo.haversine_m(0.0, 0.0, 0.0, 90.0).alias("quarter")).first()
    assert row.zero == 0 and abs(row.quarter - math.pi / 2 * geo.EARTH_M) < 1e-6


def test_speed_filter_edges(spark):
    # Exactly the greatest speed is accepted, no time is not; after an outlier at the start nothing else is reached.
    p = _points(spark, [(1, 0, 0, 0), (1, 10, 99.9 * M, 0), (1, 10, 99.9 * M, 0), (1, 11, 400 * M, 0), (2, 0, 1, 0), (2, 10, 0, 0), (3, 0, 0, 0)])
    assert [r.seq for r in T.speed_filter(p, 10.0).orderBy("seq").collect()] == [0, 1]


def test_gap_exactly_at_threshold(spark):
    p = _points(spark, [(1, 0, 0, 0), (1, 60, 0, 0), (1, 121, 0, 0), (1, 130, 0, 0)])
    assert [r.segment for r in T.time_gap_segments(p, 60).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_stay_of_exactly_the_threshold_is_none(spark):
    p = _points(spark, [(1, 0, 0, 0), (1, 60, 0, 0), (1, 120, 1, 0)])
    assert T.classic_stays(p, 100, 60).count() == 0 and T.classic_stays(p, 100, 59).count() == 2


def test_travel_pieces_need_three_points(spark):
    rows = [(1, 0, 0, 0), (1, 1, 0.1, 0), (1, 2, 0.2, 0), (1, 3, 0.3, 0), (1, 500, 0.3, 0), (1, 501, 0.5, 0), (1, 502, 0.6, 0)]
    out = T.stay_segments(_points(spark, rows), 100, 60).groupBy("part").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()
    assert [r.s for r in out] == [[0, 1, 2]]


def test_far_points_match_rescanning():
    rng = np.random.default_rng(7)
    for n, step in itertools.product((1, 2, 128, 129, 400), (0, 1e-6, 1e-4, 1e-3)):
        lat, lng = 60 + np.cumsum(rng.normal(0, step, n)), 108 + np.cumsum(rng.normal(0, step, n))
        g = kernels.Group(np.sort(rng.integers(0, 3 * n, n)) * 1_000_000, lat, lng)
        far = kernels.metres(lat[:, None], lng[:, None], lat, lng) > 50
        assert kernels.beyond(g, 50.0).tolist() == [next((j for j in range(i + 1, n) if far[i, j]), n) for i in range(n)]
        kept = [0]
        for j in range(1, n):
            dt_s = (g.micros[j] - g.micros[kept[-1]]) / 1e6
            if dt_s > 0 and kernels.metres(lat[kept[-1]], lng[kept[-1]], lat[j], lng[j]) <= 8 * dt_s:
                kept.append(j)
        assert kernels.within_speed(g, 8.0).tolist() == kept


def test_still_objects_are_not_scanned_again():
    import time

    n = 100_000
    jitter = np.random.default_rng(8).normal(0, 1e-5, (2, n))
    g = kernels.Group(np.arange(n) * 1_000_000, 34 + jitter[0], 108 + jitter[1])
    start = time.perf_counter()
    assert kernels.greedy_stays(g, 50.0, 600) == [(0, n)] and kernels.growing_stays(g, 50.0, 600) == []
    assert (kernels.beyond(g, 50.0) == n).all() and len(kernels.within_speed(g, 30.0)) == n
    assert time.perf_counter() - start < 5


def test_lines_in_metres(spark):
    bent = [(0.0, 0.0), (0.0, 1.0), (5 * M, 2.0), (0.0, 3.0), (0.0, 4.0), (200 * M, 5.0), (0.0, 6.0)]
    rows = [(1, bent), (2, bent[:4]), (3, None), (4, []), (5, [(0.0, 0.0)] * 6), (6, [*bent[:2], (None, 1.0), *bent[2:]])]
    lines = spark.createDataFrame(rows, "id long, coords array<struct<lat:double,lng:double>>").repartition(1)
    out = {r.id: r.coords and [tuple(p) for p in r.coords] for r in raster.simplify_coords(lines, 50.0).collect()}
    # Cut at the farthest point, then at the one before it, 160 m off the line to it; what lies before is 5 m off at most.
    kept = [bent[0], *bent[4:]]
    assert out == {1: kept, 2: bent[:4], 3: None, 4: [], 5: [(0.0, 0.0)] * 2, 6: kept}
    assert raster.simplify_coords(lines.limit(0), 50.0).count() == 0


def test_bilinear_crops_by_hand(spark):
    c = spark.createDataFrame([(0, 0, 4), (1, 1, 8)], "y int, x int, v int")
    regions = spark.createDataFrame([(1, 0, 2, 0, 2), (2, -1, 2, -5, 1), (3, 2, 4, 0, 2)], "region long, y0 int, y1 int, x0 int, x1 int")
    out = {(r.region, r.i, r.j): r.v for r in raster.crop_bilinear(c, regions, 2, 2, 4).collect()}
    one = np.array([[4, 0], [0, 8]], float)
    for i, j in itertools.product(range(4), repeat=2):
        y, x = (min(max((k + 0.5) / 2 - 0.5, 0), 1) for k in (i, j))
        want = (1 - y) * (1 - x) * one[0, 0] + y * x * one[1, 1] + (1 - y) * x * one[0, 1] + y * (1 - x) * one[1, 0]
        assert abs(out[1, i, j] - want) < 1e-12
        assert abs(out[2, i, j] - 4 * (1 - y)) < 1e-12  # cut to two rows of one column
    assert len(out) == 32  # the third lies outside


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    links = [(int(r), f"{a:03d}", f"{b:03d}") for r in (1, 2) for a, b in rng.integers(0, 60, (45, 2))] + [(3, f"{i:03d}", f"{i + 1:03d}") for i in range(80)]
    nodes = sorted({(r, n) for r, a, b in links for n in (a, b)} | {(4, "alone")})
    best = {n: n[1] for n in nodes}
    for _ in nodes:
        for r, a, b in links:
            best[r, a] = best[r, b] = min(best[r, a], best[r, b])
    out = network.components(spark.createDataFrame(nodes, "region long, node string"), spark.createDataFrame(links, "region long, node string, other string"))
    assert {(r.region, r.node): r.label for r in out.collect()} == best


def _density(points, dist, stay):
    out, far, start, is_open = [], -1, -1, False
    for i in range(len(points) - 1):
        j = i + 1
        while j < len(points) and abs(points[j][1] - points[i][1]) <= dist:
            j += 1
        if far < j and points[j - 1][0] - points[i][0] > stay:
            if not is_open:
                start, is_open = i, True
            far = j
        if is_open and i == far - 1:
            is_open = False
            out.append(list(range(start, far)))
    return out


def test_density_stays_match_the_definition(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for oid in range(30):
        line = [(int(s), float(m)) for s, m in zip(np.cumsum(rng.integers(1, 60, 25)), np.cumsum(rng.choice([-60, 0, 30, 300], 25)), strict=True)]
        at = len(rows)
        rows += [(oid, s, m * M, 0) for s, m in line]
        want[oid] = [[at + i for i in part] for part in _density(line, 100.001, 60)]
    out = T.density_stays(_points(spark, rows), 100.001, 60).groupBy("oid", "part").agg(F.sort_array(F.collect_list("seq")).alias("s")).orderBy("oid", "part").collect()
    assert {o: [r.s for r in out if r.oid == o] for o in want} == want


def test_position_at_ends(spark):
    p = _points(spark, [(1, 0, 0, 0), (1, 100, 1, 2)])
    at = [dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s) for s in (-1, 0, 50, 100)]
    asked = spark.createDataFrame([(1, a) for a in at], "oid long, at timestamp")
    out = {r["at"].second + 60 * r["at"].minute: r.lat for r in T.position_at(p, asked).collect() if r["at"].day == 1 and r["at"].year == 2024}
    assert out[0] == 0 and out[50] == 0.5 and out[100] is None


def test_grid_outside(spark):
    g = spatial.Grid((0.0, 0.0, 1.0, 1.0), 10, 10)
    df = spark.createDataFrame([(0.0, 0.0), (0.999, 0.5), (1.0, 0.5)], "lat double, lng double").select(g.cell(F.col("lat"), F.col("lng")).alias("c"))
    assert [r.c and (r.c.row, r.c.col) for r in df.collect()] == [(0, 0), (9, 5), None]
    with pytest.raises(Exception, match="outside of the grid"):
        spark.createDataFrame([(2.0, 0.5)], "lat double, lng double").select(g.cell(F.col("lat"), F.col("lng"), strict=True)).collect()


def test_daily_slot_raises(spark):
    t = spark.sql("select timestamp'2024-01-01 05:00:00' as t")
    with pytest.raises(Exception, match="daily index"):
        t.select(temporal.daily_slot(F.col("t"), 30, 360, 720)).collect()


def test_stay_flag_must_be_true_or_false(spark, tmp_path):
    spark.createDataFrame([("#,t,o,2024/01/01 00:00:00,x,1 km\n2024/01/01 00:00:00,1,2,yes",)], "value string").write.text(str(tmp_path / "a"))
    with pytest.raises(Exception, match="not a boolean"):
        text.read_trajectories(spark, str(tmp_path / "a"), extra=("stay",)).collect()


def test_taxi_logs_take_the_file_name(spark, tmp_path):
    (tmp_path / "taxi7.txt").write_text("7,2024-01-01 00:00:00,108.9,34.2\n7,2024-01-01 00:01:00,108.8,34.3\n")
    (tmp_path / "taxi8.txt").write_text("8,2024-01-01 00:00:00,108.9,34.2\n")
    out = text.read_taxi_logs(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r.oid, r.lat, r.lng) for r in out] == [("taxi7", 34.2, 108.9), ("taxi7", 34.3, 108.8)]


def test_numbers_are_dense_and_in_order(spark):
    from waymark.operators.numbering import numbered

    df = spark.range(500).selectExpr("(id * 7919) % 500 as k")
    assert [(r.k, r.n) for r in numbered(df, [F.col("k")], "n").orderBy("k").collect()] == [(i, i) for i in range(500)]


def test_bad_wkt_rows_are_skipped(spark, tmp_path):
    rows = [("a", "1", "2024-01-01 00:00:00", "2024-01-01 00:01:00", "LINESTRING (1 2, 3 4)"), ("b", "1", "never", "2024-01-01 00:01:00", "LINESTRING (1 2, 3 4)"), ("c", "1", "2024-01-01 00:00:00", "2024-01-01 00:01:00", "POINT (1 2)"), ("d", "1", "2024-01-01 00:00:00", "2024-01-01 00:01:00", "LINESTRING (1 2)")]
    spark.createDataFrame(rows, "tid string, oid string, start_time string, end_time string, wkt string").write.csv(str(tmp_path / "w"), header=True)
    assert [r.tid for r in text.read_wkt_csv(spark, str(tmp_path / "w")).collect()] == ["a"]


def _edges(spark, pairs):
    rows = [(1, i, u, v, [(float(u), 0.0), (float(v), 0.0)], 1.0 + i) for i, (u, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, "region long, eid long, u long, v long, coords array<struct<lat:double,lng:double>>, length double")


def test_extracts_are_read_and_placed(spark, tmp_path):
    """References keep their order and repeats; a missing node takes its way along; tags of footways and unknown ones are told apart."""
    from waymark.sources import maps

    xml = """<?xml version="1.0"?><osm>
    <node id="1" lat="34.0" lon="108.0"/><node id="2" lat="34.1" lon="108.1"><tag k="highway" v="crossing"/></node>
    <node id="3" lat="34.2" lon="108.2"/><node lat="1" lon="1"/><node id="5"/>
    <way id="10"><nd ref="3"/><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/><tag k="building" v="yes"/></way>
    <way id="11"><nd ref="1"/><nd ref="9"/><tag k="highway" v="primary"/></way>
    <way id="12"><nd ref="1"/><nd ref="2"/><tag k="highway" v="footway"/></way>
    <way id="13"><nd ref="1"/><nd ref="2"/><tag k="name" v="&lt;a &amp; b&gt;"/></way>
    <way id="14"><nd ref="1"/><nd ref="5"/><tag k="highway" v="residential"/></way>
    <way id="15"><nd ref="2"/><nd ref="1"/><tag k="building" v="yes"/><tag k="highway" v="track"/></way>
    <way id="16"/></osm>"""
    (tmp_path / "map.osm").write_text(xml)
    nodes, ways, refs = maps.read_extract(spark, str(tmp_path))
    assert (nodes.count(), ways.count(), refs.count()) == (4, 7, 14)
    got = {(r.way, r.kind): [round(c.lat, 1) for c in r.coords] for r in maps.placed_ways(nodes, ways, refs).collect()}
    assert got == {(10, "road"): [34.2, 34.0, 34.1, 34.2], (10, "building"): [34.2, 34.0, 34.1, 34.2], (15, "road"): [34.1, 34.0]}


def test_compress_chains(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (1, 7), (1, 8), (10, 11), (11, 12), (10, 12)]
    out = {tuple(min(r.nodes, r.nodes[::-1])) for r in network.compress(_edges(spark, pairs)).collect()}
    assert out == {(1, 2, 3, 4), (4, 5), (4, 6), (1, 7), (1, 8), (10, 11), (11, 12), (10, 12)}


def test_compress_splits_second_chains_and_keeps_loops(spark):
    # Junctions 1 and 2: a direct edge, chains over 3 and over 4, 5, 6, and a loop 7, 8 at 2; 9 to 10 stands alone.
    pairs = [(1, 2), (1, 3), (2, 3), (1, 4), (4, 5), (5, 6), (2, 6), (2, 7), (7, 8), (2, 8), (9, 10)]
    rows = {tuple(r.nodes): r.length for r in network.compress(_edges(spark, pairs)).collect()}
    assert rows == {(1, 2): 1.0, (1, 3): 2.0, (3, 2): 3.0, (1, 4, 5): 9.0, (5, 6, 2): 13.0, (2, 7, 8, 2): 27.0, (9, 10): 11.0}
    assert network.compress(_edges(spark, pairs).limit(0)).count() == 0


def test_distances_match_floyd_warshall(spark):
    rng = np.random.default_rng(1)
    pairs = [tuple(sorted(p)) for p in {tuple(sorted(x)) for x in rng.integers(0, 12, (18, 2)).tolist()} if p[0] != p[1]]
    d = {(a, b): 0 if a == b else math.inf for a in range(12) for b in range(12)}
    for i, (u, v) in enumerate(pairs):
        d[u, v] = d[v, u] = int((1.0 + i) * 100)
    for k, a, b in itertools.product(range(12), repeat=3):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    start = spark.createDataFrame([(1, pairs[0][0])], "region long, source long")
    for r in network.distances_cm(_edges(spark, pairs), start).collect():
        assert r.cm == (d[r.source, r.node] if d[r.source, r.node] < math.inf else -1)


def test_maximum_matching_beats_greedy():
    rng = np.random.default_rng(0)
    for _ in range(200):
        near = {u: sorted(set(rng.integers(0, 6, rng.integers(0, 4)).tolist())) for u in range(6)}
        best = max(sum(1 for u, v in enumerate(p) if v in near[u]) for p in itertools.permutations(range(6)))
        assert evaluation.maximum_matching({u: v for u, v in near.items() if v}) == best
    assert evaluation.greedy_matching([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0)])[0] == 1


def test_identical_maps_score_one(spark, sf_dir):
    from waymark.sources import fixtures as X

    e = X.trail_edges(spark, sf_dir)
    assert {round(r.apls, 9) for r in evaluation.apls(e, e, X.trail_nodes(e), 30.0).where("apls is not null").collect()} == {1.0}
    t = evaluation.topo(e, e, X.trail_nodes(e), radius=200.0, step=50.0)
    assert {(r.precision, r.recall) for r in t.collect()} <= {(1.0, 1.0), (0.0, 0.0)}


def test_viterbi_restarts():
    routes = matching.Routes(pd.DataFrame([(0, 1, 2, 100.0), (1, 2, 3, 100.0), (2, 8, 9, 100.0)], columns=["eid", "u", "v", "length"]))
    c = lambda eid, u, v, off, err=5.0: {"eid": eid, "u": u, "v": v, "length": 100.0, "offset": off, "error": err}
    steps = [[c(0, 1, 2, 50.0)], [c(1, 2, 3, 10.0), c(2, 8, 9, 0.0, 1.0)], [], [c(2, 8, 9, 5.0)], [c(0, 1, 2, 5.0)]]
    assert [p["eid"] if p else None for p in matching.viterbi(steps, [0, 60, 0, 0, 0], routes)] == [0, 1, None, 2, 0]


def test_paths_share_time_by_distance(spark):
    edges = spark.createDataFrame([(i, i, i + 1, [(0.0, i / 1000), (0.0, (i + 1) / 1000)], 100.0) for i in range(4)], "eid long, u long, v long, coords array<struct<lat:double,lng:double>>, length double")
    base = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    m = spark.createDataFrame([(1, 0, base, 0.0, 0.0005, 0, 0, 1, 100.0, 50.0), (1, 1, base + dt.timedelta(seconds=30), 0.0, 0.0035, 3, 3, 4, 100.0, 50.0)], "oid long, seq long, time timestamp, lat double, lng double, eid long, u long, v long, length double, offset double")
    out = matching.to_paths(m, edges).orderBy("pos").collect()
    assert [(r.eid, r.enter_time.second, r.leave_time.second) for r in out] == [(0, 0, 5), (1, 5, 15), (2, 15, 25), (3, 25, 30)]


def test_thinning_and_tracing():
    bar = np.zeros((9, 20), bool)
    bar[3:6, 2:18] = True
    t = raster.thin(bar)
    assert 0 < t.sum() <= 18 and (t & ~bar).sum() == 0 and raster.components(t | np.roll(t, 1, 1)).max() == 1
    plus = {((2, x), (2, x + 1)) for x in range(4)} | {((y, 2), (y + 1, 2)) for y in range(4)}
    assert sorted(len(line) for line in raster.trace(plus)) == [3, 3, 3, 3]
    ring = {((0, 0), (0, 1)), ((0, 1), (1, 1)), ((1, 1), (1, 0)), ((1, 0), (0, 0))}
    assert [line[0] == line[-1] for line in raster.trace(ring)] == [True]
    assert raster.simplify([(0, i) for i in range(9)], 1.0) == [(0, 0), (0, 8)]
    saw = [(i % 2 * 5, i) for i in range(4000)]
    assert raster.simplify(saw, 1.0) == saw and raster.simplify([], 1.0) == [] and raster.simplify(saw[:1], 1.0) == saw[:1]
    assert raster.drop_small(np.array([[1, 0, 1], [1, 0, 0]]), 2).tolist() == [[True, False, False], [True, False, False]]


def test_canvas_thinning_matches_the_array(spark):
    rng = np.random.default_rng(3)
    m = np.zeros((40, 50), bool)
    for _ in range(12):
        y, x = rng.integers(0, 30), rng.integers(0, 35)
        m[y : y + rng.integers(1, 9), x : x + rng.integers(1, 14)] = True
    on = spark.createDataFrame([(int(y), int(x)) for y, x in zip(*np.nonzero(m))], "y int, x int")
    want = {(int(y), int(x)) for y, x in zip(*np.nonzero(raster.thin(m)))}
    assert {(r.y, r.x) for r in raster.thin_pixels(on).collect()} == want
    # Small tiles: shapes cross their borders, and several passes are needed; the canvas may lie anywhere.
    moved = on.selectExpr("y - 21 AS y", "x - 33 AS x")
    assert {(r.y + 21, r.x + 33) for r in raster.thin_pixels(moved, tile=8, at_once=2).collect()} == want
    assert {(r.y, r.x) for r in raster.thin_pixels(on, tile=4, at_once=1).collect()} == want
    assert raster.thin_pixels(on.limit(0)).count() == 0


def test_small_objects_of_the_canvas_match_the_array(spark):
    m = np.random.default_rng(4).random((45, 37)) < 0.4
    on = spark.createDataFrame([(int(y) - 7, int(x) - 9) for y, x in zip(*np.nonzero(m))], "y int, x int")
    for least, tile in ((1, 256), (4, 8), (6, 5), (20, 64)):
        want = {(int(y), int(x)) for y, x in zip(*np.nonzero(raster.drop_small(m, least)))}
        assert {(r.y + 7, r.x + 9) for r in raster.drop_small_pixels(on.union(on), least, tile).collect()} == want
    assert raster.drop_small_pixels(on.limit(0), 4).count() == 0


def test_wide_boxes_meet_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    a = [(i, float(y), float(x), float(y + h), float(x + w)) for i, (y, x, h, w) in enumerate(zip(rng.uniform(-1, 1, 60), rng.uniform(-1, 1, 60), 10 ** rng.uniform(-4, 0.3, 60), 10 ** rng.uniform(-4, 0.3, 60)))]
    b = [(i, float(y), float(x), float(y + h), float(x + w)) for i, (y, x, h, w) in enumerate(zip(rng.uniform(-1, 1, 60), rng.uniform(-1, 1, 60), 10 ** rng.uniform(-4, 0.3, 60), 10 ** rng.uniform(-4, 0.3, 60)))]
    left = spark.createDataFrame(a, "i long, b0 double, b1 double, b2 double, b3 double")
    right = spark.createDataFrame(b, "j long, y0 double, x0 double, y1 double, x1 double")
    got = sorted((r.i, r.j) for r in spatial.box_join(left, right, levels=6).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


def test_maps_with_clashing_node_numbers(spark):
    e = spark.createDataFrame([(1, 0, 1, 2, 100.0), (1, 1, 2, 3, 100.0)], "region long, eid long, u long, v long, length double")
    n = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.001), (1, 3, 0.0, 0.002)], "region long, node long, lat double, lng double")
    swapped = e.withColumns({"u": 4 - F.col("u"), "v": 4 - F.col("v")})
    other = n.withColumn("node", 4 - F.col("node"))
    assert evaluation.apls(e, swapped, n, 10.0, other).first().apls == 1.0


def test_windows_of_the_patch_grid():
    assert len(raster.window_origins(5625, 6610, 256, 128)) == 52 * 44 == 2288
    assert raster.window_origins(4, 4, 2, 2) == [(0, 0), (2, 0), (0, 2), (2, 2)]
    assert raster.window_origins(5, 2, 2, 2, padding=False) == [(0, 0), (2, 0)]


def _lines(spark, lines):
    """Edges of region 1 from lines of points in metres."""
    rows = [(1, i, [(float(y) * M, float(x) * M) for y, x in line]) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "region long, eid long, coords array<struct<lat:double,lng:double>>")


def _trip_points(spark, trips):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(1, t, base + dt.timedelta(seconds=k), k, float(y) * M, float(x) * M) for t, trip in enumerate(trips) for k, (y, x) in enumerate(trip)]
    return spark.createDataFrame(rows, "region long, trip long, time timestamp, seq long, lat double, lng double")


def _metre_rows(df):
    return {(r.kind, *sorted([(round(r.lat1 / M), round(r.lng1 / M)), (round(r.lat2 / M), round(r.lng2 / M))])) for r in df.collect()}


def test_fusion_adds_a_side_road(spark):
    base = _lines(spark, [[(0, 0), (0, 400)]])
    side = _lines(spark, [[(3, 200), (50, 200)], [(50, 200), (100, 200)], [(2, 0), (2, 200)]])
    out = fusion.fuse(base, side, _trip_points(spark, []), gap_m=1000.0)
    assert _metre_rows(out) == {("split", (0, 0), (0, 200)), ("split", (0, 200), (0, 400)), ("new", (0, 200), (50, 200)), ("new", (50, 200), (100, 200))}


def test_fusion_asks_trajectories_at_junctions(spark):
    # The link from the right ends 3 m above a bend of two base edges, nearer to the one that no trip turns into.
    base = _lines(spark, [[(0, 0), (0, -100)], [(5, 0), (105, 0)]])
    side = _lines(spark, [[(3, 4), (3, 60)], [(3, 60), (3, 120)]])
    trip = [(3, 110), (3, 50), (3, 2), (0, -50), (0, -90)]
    for trips, want in (([trip, trip], (0, 0)), ([], (5, 0))):
        out = _metre_rows(fusion.fuse(base, side, _trip_points(spark, trips), gap_m=1000.0))
        assert ("new", *sorted([want, (3, 60)])) in out and ("new", (3, 60), (3, 120)) in out


def test_fusion_votes_by_trajectories(spark):
    candidates = _lines(spark, [[(0, 0), (0, 100)], [(0, 0), (-100, 0)]]).withColumn("node", F.lit("v"))
    asks = spark.createDataFrame([(1, "v", 0.0, 0.0, "o", 80 * M, 0.0)], "region long, node string, lat double, lng double, other string, other_lat double, other_lng double")
    trip, through, away = [(60, 0), (1, 0), (0, 60)], [(60, 0), (1, 0)], [(0, 60), (0, 1), (0, -60)]
    out = fusion.votes(asks, candidates, _trip_points(spark, [trip, trip[::-1], through, away]), 30.0, 15.0).collect()
    assert [(r.eid, r.n) for r in out] == [(0, 2)]


def test_long_objects_take_linear_time(spark):
    import time

    def run(n):
        p = spark.range(n).select(F.lit(1).alias("oid"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 10).alias("time"), (F.col("id") % 5000 * 0.00001).alias("lat"), F.lit(0.0).alias("lng"), F.lit("kept").alias("payload"))
        start = time.perf_counter()
        out = T.stay_segments(T.speed_filter(p, 30.0), 50.0, 3600.0)
        assert out.count() > n // 2 and "payload" in out.columns
        return time.perf_counter() - start

    run(1000)
    assert run(100_000) < 20


def test_matched_segments_keep_candidates(spark):
    p = _points(spark, [(1, k * 60, 0.01 * k, 0) for k in range(4)] + [(1, 2000 + k * 60, 0.01 * k, 0) for k in range(3)]).withColumn("eid", F.col("seq") * 7)
    out = T.matched_segments(p).orderBy("seq").collect()
    assert [(r.segment, r.eid) for r in out] == [(0, 0), (0, 7), (0, 14), (0, 21), (1, 28), (1, 35), (1, 42)]
    far = T.spaced_trajectories(p, 3000.0, 2500.0).orderBy("seq").collect()
    assert [r.seq for r in far] == [0, 1, 2, 3]


def test_directed_routes_match_floyd_warshall():
    rng = np.random.default_rng(3)
    pairs = [(u, v) for u in range(25) for v in (u + 1 if u % 5 < 4 else None, u + 5 if u < 20 else None) if v is not None]
    rows = [(k, *(p if rng.random() < 0.5 else p[::-1]), float(rng.integers(1, 9))) for k, p in enumerate(pairs)]
    rows += [(100 + k, v, u, d) for k, u, v, d in rows if k % 2]
    e = pd.DataFrame(rows, columns=["eid", "u", "v", "length"])
    far = np.full((25, 25), np.inf)
    np.fill_diagonal(far, 0)
    for _, u, v, d in rows:
        far[u, v] = min(far[u, v], d)
    for k in range(25):
        far = np.minimum(far, far[:, k : k + 1] + far[k])
    routes = matching.Routes(e, directed=True)
    places = [{"eid": k, "u": u, "v": v, "length": d, "offset": d / 4} for k, u, v, d in rows]
    for p in places:
        for q in places:
            got, ends = routes.best(p, q)
            if p["eid"] == q["eid"]:
                assert got == math.inf  # no way back on the same edge, and none without a move
            else:
                want = p["length"] * 3 / 4 + far[p["v"], q["u"]] + q["offset"]
                assert got == pytest.approx(want)
                if ends:
                    way = routes.nodes(*ends[:2])
                    assert sum(routes.near[a][b] for a, b in zip(way, way[1:])) == pytest.approx(far[p["v"], q["u"]])
    assert routes.best(places[0], {**places[0], "offset": places[0]["length"]})[0] == pytest.approx(places[0]["length"] * 3 / 4)


def test_traced_canvas_matches_the_kernel(spark):
    rng = np.random.default_rng(5)
    mask = raster.thin(np.kron(rng.random((12, 14)) < 0.55, np.ones((3, 3), int)))
    mask[40:45, 40:45] = 0
    mask = np.pad(mask, ((0, 12), (0, 12)))
    mask[40, 42:46] = mask[46, 42:46] = True  # a ring apart from all
    mask[41:46, 41] = mask[41:46, 46] = True
    on = [(int(y), int(x)) for y, x in zip(*np.nonzero(mask))]
    pixels = spark.createDataFrame([(0, y, x) for y, x in on], "tile int, y int, x int")
    graph = raster.pixel_graph(pixels)
    want = raster.trace({((g.y, g.x), (g.ny, g.nx)) for g in graph.collect()})
    got = [[(p.y, p.x) for p in row.points] for row in raster.trace_pixels(graph).collect()]
    same = lambda line: min(tuple(line), tuple(line[::-1]))
    assert len(got) > 20 and any(line[0] == line[-1] for line in got)
    assert sorted(map(same, got)) == sorted(map(same, want))
    e = raster.lines_to_network(raster.trace_pixels(graph), 34.3, 108.9, 0.0001, 1.0).collect()
    assert [x.eid for x in sorted(e, key=lambda x: x.eid)] == list(range(len(e))) and all(x.length > 0 for x in e)
    assert len({frozenset((x.u, x.v)) for x in e}) == len(e)
    none = raster.pixel_graph(spark.createDataFrame([], "tile int, y int, x int"))
    assert raster.lines_to_network(raster.trace_pixels(none), 34.3, 108.9, 0.0001).count() == 0


def test_polygons_by_the_even_odd_rule(spark):
    ring = lambda *ps: [{"y": float(y), "x": float(x)} for y, x in ps]
    rows = [("square", ring((1, 1), (1, 4), (3, 4), (3, 1))), ("bow", ring((0, 0), (4, 4), (4, 0), (0, 4))), ("line", ring((0, 0), (3, 3))), ("none", None), ("out", ring((-5, -5), (-5, 9), (9, 9), (9, -5)))]
    got = raster.fill_polygons(spark.createDataFrame(rows, "name string, ring array<struct<y:double,x:double>>"), 4, 5).collect()
    of = lambda n: sorted((g.y, g.x) for g in got if g.name == n)
    assert of("square") == [(y, x) for y in (1, 2) for x in (1, 2, 3)]
    assert of("out") == [(y, x) for y in range(4) for x in range(5)]
    # Pixels on the left border belong to the polygon, those on the right do not.
    assert of("bow") == [(0, 0), (0, 1), (0, 2), (1, 1), (2, 1), (3, 0), (3, 1), (3, 2)]
    assert of("line") == of("none") == []


def test_random_windows_keep_to_their_subset(spark):
    draws = spark.range(400).withColumnRenamed("id", "idx")
    w = raster.random_corners(draws, "idx", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("all")), (F.col("idx") % 3 + 1).cast("int")), 30, 40, 8, 0.5).collect()
    assert {x.wx for x in w} == set(range(22))
    assert {x.wy for x in w if x.subset == "train"} == set(range(12)) and {x.wy for x in w if x.subset == "val"} == set(range(20, 32))
    assert max(x.wy for x in w if x.subset == "all") <= 31
    with pytest.raises(ValueError):
        raster.random_corners(draws, "idx", F.lit("val"), 30, 12, 8, 0.5)


def test_better_results_replace_their_neighbours(spark):
    e = spark.createDataFrame([(0, k, k + 1, 10.0) for k in range(6)], "region long, u long, v long, length double")
    s = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.8), (0, 2, 0.95), (0, 3, 0.97), (0, 6, 0.2), (0, 5, None)], "region long, start long, precision double")
    kept = {r.start for r in evaluation.thin_results(s, e, apart_m=15.0).collect()}
    assert kept == {3, 2, 0, 6}  # 2 is good enough beside 3, 1 is not beside 2, 0 is beyond both, 5 goes with 6
    near = {0: {1: 10.0}, 1: {0: 10.0, 2: 10.0}, 2: {1: 10.0}}
    d = evaluation.location_distance
    assert d(near, (0, 1, 4.0, 6.0), (1, 2, 3.0, 7.0), 100.0) == 9.0 and d(near, (0, 1, 4.0, 6.0), (1, 2, 3.0, 7.0), 8.0) is None
    assert d(near, (0, 1, 4.0, 6.0), (1, 0, 2.0, 8.0), 100.0) == 4.0


def test_early_stop_ignores_ties(spark):
    e = spark.createDataFrame([(1, i, f) for i, f in enumerate([0.5, 0.5, 0.4, 0.6, 0.5, 0.5])], "run int, epoch int, f1 double")
    assert [r.counter for r in evaluation.early_stopping(e, 2).orderBy("epoch").collect()] == [0, 0, 1, 0, 1, 2]


def test_streaming_twins(spark, tmp_path):
    from waymark.streaming import jobs

    rows = [(1, 0, 0, 0), (1, 10, 50 * M, 0), (1, 11, 900 * M, 0), (1, 30, 150 * M, 0), (2, 5, 0, 0)]
    p = _points(spark, rows)
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("filtered", jobs.speed_filter(stream, 10.0), "append"), ("sessions", jobs.sessions(stream, "15 seconds"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.seq for r in spark.table("filtered").collect()) == [0, 1, 3, 4]
    assert sorted((r.oid, r.n) for r in spark.table("sessions").collect()) == [(1, 1), (1, 3), (2, 1)]


def test_engine_stands_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for part in ("waymark", "tests"):
        shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), *[p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != str(root)]])}
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q) and 'pipeline' not in q; import tests.test_engine"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
    some = "idx_cells or tim_slots or geo_distances"
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_engine.py", "-k", some], cwd=tmp_path, env=env, check=True, timeout=300)


def test_entry_is_loud_about_a_broken_package(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # as if it weren't there
    assert "pipeline" not in e.queries() and "flt_speed" in e.queries()
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    real = __import__

    def broken(name, *args, **more):
        if name == "corpus_pipeline":
            raise ImportError("cannot import name", name="waymark.llm.common")
        return real(name, *args, **more)

    monkeypatch.setattr("builtins.__import__", broken)
    with pytest.raises(ImportError):
        e.queries()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
