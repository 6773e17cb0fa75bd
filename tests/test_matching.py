"""Routes, chains in chunks and matching against plain versions."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import matching, network, routing, viterbi

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
EDGES = "eid long, u long, v long, coords array<struct<lat:double,lng:double>>"


def lattice(spark, n, lat=34.0, gone=()):
    """n by n nodes 0.001 degrees apart, without some edges (pairs of nodes)."""
    at = lambda k: (lat + 0.001 * (k // n), 108.0 + 0.001 * (k % n))
    pairs = [(k, k + 1) for k in range(n * n) if k % n < n - 1] + [(k, k + n) for k in range(n * n - n)]
    rows = [(i, u, v, [at(u), at(v)]) for i, (u, v) in enumerate(p for p in pairs if p not in gone)]
    return spark.createDataFrame(rows, EDGES).withColumn("length", geo.length_m(F.col("coords")))


def plain_distances(edges, directed=False):
    near = {}
    for e in edges.collect():
        for a, b in ((e.u, e.v),) if directed else ((e.u, e.v), (e.v, e.u)):
            near.setdefault(a, {})[b] = min(e.length, near.get(a, {}).get(b, 1e18))
    return near, {a: network.shortest(near, a) for a in near}


@pytest.mark.parametrize("directed,bounds", [(False, (10.0, 150.0)), (True, ())])
def test_distances_beyond_all_bounds(spark, directed, bounds):
    edges = lattice(spark, 4, 60.0, gone={(1, 5), (5, 9), (2, 6), (9, 10)})
    near, want = plain_distances(edges, directed)
    pairs = spark.createDataFrame([(a, b) for a in range(16) for b in range(16)] + [(3, 4), (None, 1)], "a long, b long")
    expected = {(a, b): d for a, to in want.items() for b, d in to.items()} | {(k, k): 0.0 for k in range(16)}
    got = routing.distances(pairs, edges, matching.network_nodes(edges), directed, with_nodes=True, bounds=bounds).collect()
    assert {(r.a, r.b): round(r.dist, 6) for r in got} == {k: round(d, 6) for k, d in expected.items()}
    for r in got:
        assert r.via[0] == r.a and r.via[-1] == r.b and abs(sum(near[x][y] for x, y in zip(r.via, r.via[1:])) - r.dist) < 1e-6


def test_between_places(spark):
    edges = lattice(spark, 4)
    _, d = plain_distances(edges)
    rows = {e.eid: e for e in edges.collect()}
    r = random.Random(4)
    cases = [(k, r.choice(list(rows)), r.random(), r.choice(list(rows)), r.random()) for k in range(40)] + [(40, 3, 0.25, 3, 0.75)]
    out, want = [], {}
    for k, p, x, q, y in cases:
        a, b = rows[p], rows[q]
        ways = [da + d[m].get(n, 1e9) * (m != n) + db for m, da in ((a.u, x * a.length), (a.v, (1 - x) * a.length)) for n, db in ((b.u, y * b.length), (b.v, (1 - y) * b.length))]
        want[k] = min(ways + ([abs(x - y) * a.length] if p == q else []))
        out.append((k, a.u, a.v, x * a.length, a.length, b.u, b.v, y * b.length, b.length))
    pairs = spark.createDataFrame(out, "id long, p_u long, p_v long, p_off double, p_length double, q_u long, q_v long, q_off double, q_length double")
    got = {x.id: x.dist for x in routing.between_places(pairs, edges, matching.network_nodes(edges)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    near = {x.id: x.dist for x in routing.between_places(pairs, edges, matching.network_nodes(edges), 150.0).collect()}
    assert {k for k, v in near.items() if v is not None} == {k for k, v in want.items() if v <= 150.0}


def plain_chain(steps):
    """steps: (emission, move rows); the sequence by one forward pass."""
    out, chain = [], []

    def close():
        if chain:
            k, picked = int(np.argmax(chain[-1][0])), []
            for _, back in reversed(chain):
                picked.append(k)
                k = back[k] if back is not None else None
            out.extend(reversed(picked))
            chain.clear()

    for emission, move in steps:
        if not emission:
            close()
            out.append(None)
            continue
        if chain:
            before, score, back = chain[-1][0], [], []
            for j in range(len(emission)):
                ways = [(before[i] + move[i][j] if move[i][j] > viterbi.DEAD and before[i] > viterbi.DEAD else viterbi.NEVER, -i) for i in range(len(before))]
                best = max(ways)
                score.append(best[0] + emission[j] if best[0] > viterbi.DEAD else viterbi.NEVER)
                back.append(-best[1])
            if max(score) > viterbi.DEAD:
                chain.append((score, back))
                continue
            close()
        chain.append((list(emission), None))
    close()
    return out


@pytest.mark.parametrize("chunk", [1, 7])
def test_chains_in_chunks(spark, chunk):
    r = random.Random(chunk)
    rows, want = [], {}
    for oid in range(12):
        steps, n_before = [], 0
        for t in range(r.choice([1, 2, 20, 45])):
            n = r.choice([0, 1, 2, 3, 3]) if r.random() < 0.3 else r.choice([1, 2, 3])
            emission = [-r.randint(0, 4) for _ in range(n)]
            move = [[viterbi.NEVER if r.random() < 0.45 else -r.randint(0, 4) for _ in range(n)] for _ in range(n_before)]
            steps.append((emission, move))
            rows.append((oid, t, n_before, emission, sum(move, []) if n else []))
            n_before = n
        want[oid] = plain_chain(steps)
    df = spark.createDataFrame(rows, "oid long, t long, n_before int, emission array<long>, move array<long>")
    got = {}
    for x in viterbi.most_likely(df, chunk).orderBy("oid", "t").collect():
        got.setdefault(x.oid, []).append(x.state)
    assert got == want


def drive(n, seed, oid, lat=34.0, noise=0.00012):
    """Noisy points of a random walk over the lattice."""
    r = random.Random(seed)
    y, x, out = 2.0, 2.0, []
    for k in range(n):
        if r.random() < 0.06:
            out.append((lat + 1.0, 109.0))
        else:
            dy, dx = r.choice([(0, 0.6), (0.6, 0), (0, -0.6), (-0.6, 0)])
            y, x = min(max(y + dy, 0), 4), min(max(x + dx, 0), 4)
            out.append((lat + 0.001 * y + r.gauss(0, noise), 108.0 + 0.001 * x + r.gauss(0, noise)))
    return [(oid, k, BASE + dt.timedelta(seconds=10 * k), a, b) for k, (a, b) in enumerate(out)]


POINTS = "oid long, seq long, time timestamp, lat double, lng double"


@pytest.mark.parametrize("directed", [False, True])
def test_match_against_one_process(spark, directed):
    # Two streets are cut, so that some routes between neighbouring points go 2 km round.
    edges = lattice(spark, 5, gone={(k, k + 5) for k in range(11, 15)} | {(6, 7), (11, 12)})
    if directed:
        back = edges.where("eid % 4 <> 1").select((F.col("eid") + 100).alias("eid"), F.col("v").alias("u"), F.col("u").alias("v"), F.reverse("coords").alias("coords"), "length")
        edges = edges.unionByName(back)
    rows = sum((drive(40, s, s) for s in range(4)), [])
    points = spark.createDataFrame(rows, POINTS)
    from waymark.operators import spatial

    found = {}
    for c in spatial.candidates(points, edges, 50.0).collect():
        found.setdefault((c.oid, c.seq), []).append(c.asDict())
    routes = matching.Routes(edges.toPandas(), directed)
    straight = {(x.oid, x.seq): x.d or 0.0 for x in points.selectExpr("*", "lag(lat) over (partition by oid order by seq) y", "lag(lng) over (partition by oid order by seq) x").select("oid", "seq", geo.haversine_m(F.col("y"), F.col("x"), F.col("lat"), F.col("lng")).alias("d")).collect()}
    matched = matching.match(points, edges, directed=directed, chunk=7, bounds=(200.0,))
    got = {(x.oid, x.seq): x.eid for x in matched.collect()}
    assert len(got) == len(rows)
    for oid in range(4):
        steps = [sorted(found.get((oid, k), []), key=lambda c: c["eid"]) for k in range(40)]
        one = matching.viterbi(steps, [straight[oid, k] for k in range(40)], routes)
        assert [got[oid, k] for k in range(40)] == [c["eid"] if c else None for c in one]
    paths = matching.to_paths(matched, edges, directed, bounds=(200.0,)).orderBy("oid", "path", "pos").collect()
    by_eid, last = {e.eid: e for e in edges.collect()}, None
    assert paths
    for p in paths:
        assert p.enter_time <= p.leave_time
        if last is not None and (last.oid, last.path) == (p.oid, p.path):
            a, b = by_eid[last.eid], by_eid[p.eid]
            assert p.pos == last.pos + 1 and last.leave_time == p.enter_time and {a.u, a.v} & {b.u, b.v} and (not directed or a.v == b.u)
        else:
            assert p.pos == 0
        last = p


def test_one_long_object(spark):
    """100 000 points of one object over a lattice, in many chunks."""
    n = 100_000
    edges = lattice(spark, 5)
    k = F.col("id")
    lap = k % 16
    y = F.when(lap < 4, F.lit(0)).when(lap < 8, lap - 4).when(lap < 12, F.lit(4)).otherwise(16 - lap)
    x = F.when(lap < 4, lap).when(lap < 8, F.lit(4)).when(lap < 12, 12 - lap).otherwise(F.lit(0))
    points = spark.range(n).select(F.lit(1).cast("long").alias("oid"), k.alias("seq"), F.timestamp_seconds(k).alias("time"), (34.0 + 0.001 * y + 0.0003).alias("lat"), (108.0 + 0.001 * x + 0.0002).alias("lng"))
    out = matching.match(points, edges)
    assert out.groupBy(F.col("eid").isNull().alias("none")).count().collect() == [(False, n)]


def test_boxes_far_north(spark):
    from waymark.operators import spatial

    edges = lattice(spark, 3, 60.0)
    nodes = matching.network_nodes(edges).select("node", F.col("lat").alias("y"), F.col("lng").alias("x"))
    points = spark.createDataFrame([(1, 60.0005, 108.0008), (2, 60.0, 108.0008), (3, -60.0, 0.0)], "id long, lat double, lng double")
    near = [(r.id, r.node) for r in spatial.nearest(points, ["id"], nodes, 1, 50.0).collect()]
    assert near == [(2, 1)]
    every = {(r.id, r.node): r.dist for r in spatial.nearest_any(points.where("id < 3"), ["id"], nodes, 2, 10.0).collect()}
    plain = points.where("id < 3").crossJoin(nodes).select("id", "node", geo.haversine_m(F.col("lat"), F.col("lng"), F.col("y"), F.col("x")).alias("d")).toPandas()
    assert set(every) == {(i, n) for i, g in plain.groupby("id") for n in g.nsmallest(2, "d").node}


@pytest.mark.parametrize("directed", [False, True])
def test_routes_are_asked_once_for_the_same_streets(spark, monkeypatch, directed):
    """Two thousand moves between a few streets ask for no more routes than these streets have ends."""
    edges, asked, distances = lattice(spark, 3), [], routing.distances
    k = F.col("id")
    points = spark.range(2000).select((k % 3).alias("oid"), k.alias("seq"), F.timestamp_seconds(k).alias("time"), (34.0 + 0.0005 * (k % 2)).alias("lat"), (108.0 + 0.0005 * (F.floor(k / 2) % 2)).alias("lng"))
    monkeypatch.setattr(routing, "distances", lambda pairs, *x, **y: (asked.append(pairs.count()), distances(pairs, *x, **y))[1])
    out = matching.match(points, edges, directed=directed)
    # Going back and forth on one-way streets makes no paths.
    assert out.count() == 2000 and (matching.to_paths(out, edges, directed).count() > 0) == (not directed)
    assert len(asked) == 2 and max(asked) <= 600


def test_regions_in_one_place_are_dealt_over_parts(spark, monkeypatch):
    """Forty regions upon each other: a part holds few of them, and distances stay those of each region."""
    edges = lattice(spark, 4)
    _, want = plain_distances(edges)
    every = spark.range(40).withColumnRenamed("id", "region")
    name = lambda c: F.col("region") * 100 + F.col(c)
    many = every.crossJoin(edges).select("eid", name("u").alias("u"), name("v").alias("v"), "length")
    nodes = every.crossJoin(matching.network_nodes(edges)).select("region", name("node").alias("node"), "lat", "lng")
    pairs = every.selectExpr("region * 100 as a", "region * 100 + 15 as b")
    monkeypatch.setattr(routing, "PART_WAYS", 200)
    sizes = routing._dealt(nodes, routing.steps(many, False)).groupBy("part").count().collect()
    assert len(sizes) >= 7 and max(x["count"] for x in sizes) < 16 * 20
    got = routing.distances(pairs, many, nodes, most=2000.0).collect()
    assert {x.a: round(x.dist, 6) for x in got} == {100 * k: round(want[0][15], 6) for k in range(40)}
