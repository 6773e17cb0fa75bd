"""Shortest routes over a road network of any size, for tables of questions.

edges: eid, u, v, length (metres, above 0). On a directed network they lead from u to v, else both ways. nodes: node, lat, lng,
and region if the network falls into regions without ways between them: these are dealt over parts, since many may lie in one cell.

`distances` answers pairs of nodes. A route of at most so many metres stays within that distance of where it starts, so the
network is cut into cells, each task gets the edges around one cell, and the search ends at a bound. Pairs that no route within
the bound joins are asked again with a bound four times as large (a found route is proven, as shorter ones would have been found
too); those left after the last bound go on over the whole network by `reach`, whose joins follow all origins at once. So no
margin cuts a route off, and no task holds the network.
"""

from __future__ import annotations

import functools
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .spatial import DEGREE_M, lng_degrees

#: Metres of the bounds within one task; beyond the last one the search goes on by joins.
BOUNDS = (500.0, 2000.0, 8000.0)
#: Lengths that differ by less are equal.
EQUAL_M = 1e-6
#: Ways of a part, about, where a network falls into regions.
PART_WAYS = 100_000


def steps(edges: DataFrame, directed: bool) -> DataFrame:
    """a, b, eid, length: each way along an edge; of parallel ways the shortest, then the one with the smallest number."""
    ways = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "eid", "length")
    if not directed:
        ways = ways.unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b"), "eid", "length"))
    best = ways.where("a <> b").groupBy("a", "b").agg(F.min(F.struct("length", "eid")).alias("w"))
    return best.select("a", "b", "w.eid", "w.length")


def reach(starts: DataFrame, ways: DataFrame, bound: float | None = None) -> DataFrame:
    """key, node, dist: all nodes within the bound of the starts (key, node, dist; several nodes of a key start together).

    Each round follows the ways of the nodes that got nearer in the round before, for all keys at once; distances may fall later
    (label correcting), and the rounds end when none does. bound: metres for all keys, or none.
    """
    best = stored(starts.groupBy("key", "node").agg(F.min("dist").alias("dist")), "reach")
    near = best
    while True:
        further = near.join(ways, F.col("node") == F.col("a")).select("key", F.col("b").alias("node"), (F.col("dist") + F.col("length")).alias("dist"))
        if bound is not None:
            further = further.where(F.col("dist") <= bound)
        further = further.groupBy("key", "node").agg(F.min("dist").alias("dist"))
        old = best.select("key", "node", F.col("dist").alias("old"))
        near = stored(further.join(old, ["key", "node"], "left").where(F.col("old").isNull() | (F.col("dist") < F.col("old") - EQUAL_M)).select("key", "node", "dist"), "nearer")
        if near.isEmpty():
            return best
        best = stored(best.unionByName(near).groupBy("key", "node").agg(F.min("dist").alias("dist")), "reach")


def _cells(lat: Column, lng: Column, size: float, margin: float) -> Column:
    """Keys of the cells (size metres high and about as wide) that a place lies in, or within margin metres of."""
    high, up = size / DEGREE_M, margin / DEGREE_M
    rows = F.sequence(F.floor((lat - up) / high).cast("long"), F.floor((lat + up) / high).cast("long"))

    def of(row: Column) -> Column:
        # All cells of a row are as wide in degrees, by the row's farther side.
        width = lng_degrees(F.greatest(F.abs(row * high), F.abs((row + 1) * high)), size)
        side = lng_degrees(F.abs(lat), margin) if margin else F.lit(0.0)
        at = lambda x: F.floor(x / width).cast("long")
        return F.transform(F.sequence(at(lng - side), at(lng + side)), lambda col: row * 100_000_000 + col)

    return F.flatten(F.transform(rows, of))


def _search(near: dict, start, wanted: set, bound: float) -> tuple[dict, dict]:
    """Distances from start of the nodes within bound, and the wanted ones among them; ends when all those are settled."""
    best, heap, settled, left = {start: 0.0}, [(0.0, start)], {}, set(wanted)
    while heap and left:
        d, n = heapq.heappop(heap)
        if n in settled:
            continue
        settled[n] = d
        left.discard(n)
        for m, w in near.get(n, ()):
            if d + w <= bound and d + w < best.get(m, float("inf")):
                best[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return settled, {n: settled[n] for n in wanted if n in settled}


def _back(into: dict, settled: dict, a, b) -> list:
    """Nodes of the shortest way from a to b, walked back along falling distances; of equal ones the smallest node."""
    out, order = [b], {n: k for k, n in enumerate(settled)}
    while out[-1] != a:
        n = out[-1]
        out.append(min(m for m, w in into[n] if m in settled and abs(settled[m] + w - settled[n]) < EQUAL_M and order[m] < order[n]))
    return out[::-1]


def _dealt(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """node, part, lat, lng: the nodes of a region belong to one part; without regions there is one part."""
    if "region" not in nodes.columns:
        return nodes.select("node", F.lit(0).alias("part"), "lat", "lng")
    parts = max(1, -(-ways.count() // PART_WAYS))
    return nodes.select("node", F.pmod(F.xxhash64("region"), F.lit(parts)).cast("int").alias("part"), "lat", "lng")


def _within(pairs: DataFrame, ways: DataFrame, nodes: DataFrame, bound: float, with_nodes: bool) -> DataFrame:
    """a, b, dist (and the nodes on the way) of those pairs that a route within the bound joins. nodes: as _dealt has them."""
    starts = pairs.join(nodes.withColumnRenamed("node", "a"), "a")
    asked = starts.withColumn("cell", F.element_at(_cells(F.col("lat"), F.col("lng"), bound, 0.0), 1)).select("part", "cell", "a", "b")
    # Both ends of each way on a route lie within the bound; a little more for lengths that are rounded.
    around = nodes.select(F.col("node").alias("a"), "part", F.explode(_cells(F.col("lat"), F.col("lng"), bound, bound * 1.01 + 1.0)).alias("cell"))
    local = around.join(asked.select("part", "cell").distinct(), ["part", "cell"], "left_semi").join(ways.drop("eid"), "a").select(F.col("part").alias("of"), F.col("cell").alias("at"), "a", "b", "length")
    kind = "a long, b long, dist double" + (", via array<long>" if with_nodes else "")

    def run(asked: pd.DataFrame, local: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        into: dict = {}
        for a, b, w in zip(local.a.tolist(), local.b.tolist(), local.length.tolist(), strict=True):
            near.setdefault(a, []).append((b, w))
            into.setdefault(b, []).append((a, w))
        rows = []
        for a, wanted in asked.groupby("a")["b"]:
            settled, found = _search(near, a, set(wanted.tolist()), bound)
            rows += [(a, b, d, _back(into, settled, a, b)) if with_nodes else (a, b, d) for b, d in found.items()]
        return pd.DataFrame(rows, columns=["a", "b", "dist", "via"][: 4 if with_nodes else 3])

    return asked.groupBy("part", "cell").cogroup(local.groupBy("of", "at")).applyInPandas(run, kind)


def _by_joins(pairs: DataFrame, ways: DataFrame, with_nodes: bool) -> DataFrame:
    """The same over the whole network, without a bound."""
    known = reach(pairs.select(F.col("a").alias("key"), F.col("a").alias("node"), F.lit(0.0).alias("dist")).distinct(), ways)
    found = pairs.join(known.select(F.col("key").alias("a"), F.col("node").alias("b"), "dist"), ["a", "b"])
    if not with_nodes:
        return found.select("a", "b", "dist")
    walks, done = stored(found.select("a", "b", "dist", F.array("b").alias("via"), F.col("dist").alias("left")), "walks"), []
    before = known.select(F.col("key").alias("a"), F.col("node").alias("m"), F.col("dist").alias("to_m"))
    while True:
        done.append(walks.where(F.element_at("via", 1) == F.col("a")).drop("left"))
        rest = walks.where(F.element_at("via", 1) != F.col("a"))
        if rest.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        on = rest.withColumn("n", F.element_at("via", 1)).join(ways.select(F.col("a").alias("m"), F.col("b").alias("n"), "length"), "n").join(before, ["a", "m"])
        on = on.where((F.abs(F.col("to_m") + F.col("length") - F.col("left")) < EQUAL_M) & (F.col("to_m") < F.col("left")))
        step = on.groupBy("a", "b").agg(F.min(F.struct("m", "to_m", "via", "dist")).alias("s"))
        walks = stored(step.select("a", "b", "s.dist", F.concat(F.array("s.m"), "s.via").alias("via"), F.col("s.to_m").alias("left")), "walks")


def distances(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, directed: bool = False, with_nodes: bool = False, bounds: tuple[float, ...] = BOUNDS, most: float | None = None) -> DataFrame:
    """a, b, dist of each distinct pair (a, b) that a route joins; with_nodes: also via, the nodes on the shortest one in order.
    most: metres beyond which routes aren't asked for."""
    ways = stored(steps(edges, directed), "ways")
    open_pairs = stored(pairs.select("a", "b").where("a is not null and b is not null").distinct(), "pairs")
    nodes, found = _dealt(nodes, ways), []
    if most is not None and bounds and most <= bounds[-1]:
        return _within(open_pairs, ways, nodes, most, with_nodes)
    for bound in bounds:
        found.append(stored(_within(open_pairs, ways, nodes, bound, with_nodes), "within"))
        open_pairs = stored(open_pairs.join(found[-1].select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if open_pairs.isEmpty():
            break
    else:
        found.append(stored(_by_joins(open_pairs, ways, with_nodes), "joined"))
    return functools.reduce(DataFrame.unionByName, found)


def between_places(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, limit: float | None = None) -> DataFrame:
    """id, dist: metres along the undirected map between two places on edges; null beyond the limit or without a way.

    pairs: id, p_u, p_v, p_off, p_length and the same with q: the edge's ends, the metres from u, the edge's length. On one edge
    the way along it counts too (an edge from v to u is the same one). The ends of the first edge are searched from until the
    searches meet the ends of the second.
    """
    ends = lambda s: F.array(F.struct(F.col(f"{s}_u").alias("n"), F.col(f"{s}_off").alias("m")), F.struct(F.col(f"{s}_v").alias("n"), (F.col(f"{s}_length") - F.col(f"{s}_off")).alias("m")))
    open_ways = pairs.withColumn("p", F.explode(ends("p"))).withColumn("q", F.explode(ends("q"))).select("id", F.col("p.n").alias("a"), F.col("q.n").alias("b"), (F.col("p.m") + F.col("q.m")).alias("off"))
    routes = distances(open_ways, edges, nodes, most=limit)
    over = open_ways.join(routes, ["a", "b"]).select("id", (F.col("dist") + F.col("off")).alias("dist"))
    same, turned = (F.col("p_u") == F.col("q_u")) & (F.col("p_v") == F.col("q_v")), (F.col("p_u") == F.col("q_v")) & (F.col("p_v") == F.col("q_u"))
    along = pairs.select("id", F.when(same, F.abs(F.col("p_off") - F.col("q_off"))).when(turned, F.abs(F.col("p_off") - (F.col("q_length") - F.col("q_off")))).alias("dist"))
    best = over.unionByName(along).groupBy("id").agg(F.min("dist").alias("dist"))
    if limit is not None:
        best = best.withColumn("dist", F.when(F.col("dist") <= limit, F.col("dist")))
    return pairs.select("id").distinct().join(best, "id", "left")
