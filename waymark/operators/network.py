"""Operators on road networks as tables: edges (region, eid, u, v, coords, length), nodes (region, node, lat, lng).

Every operator keeps regions apart and partitions by region or by node. Chains are followed by joins that double their reach;
shortest paths run as a kernel over one region's edges, of which a region has boundedly many (a map tile).
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import stored


def undirected(u: Column, v: Column) -> tuple[Column, Column]:
    return F.least(u, v), F.greatest(u, v)


def numbered(edges: DataFrame) -> DataFrame:
    """eid from 0 in each region, by ends."""
    return edges.withColumn("eid", (F.row_number().over(Window.partitionBy("region").orderBy("u", "v")) - 1).cast("long"))


def to_directed(edges: DataFrame) -> DataFrame:
    """Both directions; the backward ones are numbered on from the largest number of the region, coords reversed."""
    w = Window.partitionBy("region")
    back = edges.withColumn("top", F.max("eid").over(w)).withColumn("rank", F.row_number().over(w.orderBy("eid")))
    back = back.select("region", (F.col("top") + F.col("rank")).cast("long").alias("eid"), F.col("v").alias("u"), F.col("u").alias("v"), F.reverse("coords").alias("coords"), "length")
    return edges.select("region", "eid", "u", "v", "coords", "length").unionByName(back)


def to_undirected(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each pair of directions the smaller number stays; and (region, eid, new_eid) for all edges."""
    a, b = undirected(F.col("u"), F.col("v"))
    marked = edges.withColumn("new_eid", F.min("eid").over(Window.partitionBy("region", a, b)))
    return marked.where("eid = new_eid").drop("new_eid"), marked.select("region", "eid", "new_eid")


def densify(edges: DataFrame, step_m: float) -> DataFrame:
    """Each segment in ceil(length / step) equal parts, each an edge: region, eid (of its origin), segment, part, ends."""
    seg = edges.select("region", "eid", F.posexplode(F.arrays_zip(F.slice("coords", 1, F.size("coords") - 1).alias("a"), F.slice("coords", 2, F.size("coords") - 1).alias("b"))).alias("segment", "s"))
    a, b = F.col("s.a"), F.col("s.b")
    n = F.greatest(F.ceil(geo.haversine_m(a["lat"], a["lng"], b["lat"], b["lng"]) / step_m).cast("int"), F.lit(1))
    part = seg.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def at(k):
        y, x = geo.interpolate(a["lat"], a["lng"], b["lat"], b["lng"], k / F.col("n"))
        return F.struct(F.when(k == 0, a["lat"]).when(k == F.col("n"), b["lat"]).otherwise(y).alias("lat"), F.when(k == 0, a["lng"]).when(k == F.col("n"), b["lng"]).otherwise(x).alias("lng"))

    return part.select("region", "eid", "segment", "part", at(F.col("part")).alias("from"), at(F.col("part") + 1).alias("to"))


def densify_metric(edges: DataFrame, longest_m: float = 3.0, step_m: float = 2.0) -> DataFrame:
    """The metric's rule: edges longer than longest_m in int(d / step) + 1 parts: region, eid, part, lat1, lng1, lat2, lng2."""
    a, b = F.element_at("coords", 1), F.element_at("coords", -1)
    d = geo.planar_m(a["lat"], a["lng"], b["lat"], b["lng"])
    n = F.when(d > longest_m, (d / step_m).cast("int") + 1).otherwise(1)
    part = edges.select("region", "eid", a.alias("a"), b.alias("b"), n.alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    mixed = lambda k, c: F.col(f"a.{c}") * (1 - k / F.col("n")) + F.col(f"b.{c}") * (k / F.col("n"))
    return part.select("region", "eid", "part", *[mixed(F.col("part") + j, c).alias(f"{c}{j + 1}") for j in (0, 1) for c in ("lat", "lng")])


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("region", F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("region", "v", "u")).where("node <> other").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("region", "node").agg(F.count(F.lit(1)).alias("degree"))


def prune_dead_ends(edges: DataFrame, rounds: int = 1) -> DataFrame:
    """Edges without those at nodes of degree 1, again for each round."""
    for _ in range(rounds):
        ends = degrees(edges).where("degree = 1").select("region", "node")
        for c in ("u", "v"):
            edges = edges.join(ends.withColumnRenamed("node", c), ["region", c], "left_anti")
    return edges


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """region, start, node, hop: nodes within so many hops of the starts (region, start), with the least hop."""
    nb = both_ways(edges)
    seen = starts.select("region", "start", F.col("start").alias("node"), F.lit(0).alias("hop"))
    for k in range(1, hops + 1):
        new = seen.join(nb, ["region", "node"]).select("region", "start", F.col("other").alias("node"), F.lit(k).alias("hop"))
        seen = seen.unionByName(new).groupBy("region", "start", "node").agg(F.min("hop").alias("hop"))
    return seen


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """region, node, neighbours (sorted)."""
    return both_ways(edges).groupBy("region", "node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def graph_json(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """region, json: [[ [lat, lng], ... ], [ [i, j], ... ]] with nodes numbered by id and each edge once."""
    n = nodes.withColumn("i", F.row_number().over(Window.partitionBy("region").orderBy("node")) - 1)
    at = lambda c: n.select("region", F.col("node").alias(c), F.col("i").alias(f"i{c}"))
    a, b = undirected(F.col("iu"), F.col("iv"))
    e = edges.join(at("u"), ["region", "u"]).join(at("v"), ["region", "v"]).where("iu <> iv").groupBy("region").agg(F.array_sort(F.collect_set(F.array(a, b))).alias("e"))
    p = n.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lat", "lng"))), lambda x: F.array(x["lat"], x["lng"])).alias("p"))
    return p.join(e, "region", "left").select("region", F.concat(F.lit("["), F.to_json("p"), F.lit(","), F.coalesce(F.to_json("e"), F.lit("[]")), F.lit("]")).alias("json"))


def walked_steps(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """steps (a, b, c: from a to b, then c, null at an end) to the last step (ja, jb) of the line and the number of steps to it,
    by doubling; and the steps of rings, which have no end, with the least pixel of their ring."""
    ends = F.col("c").isNull()
    state = steps.select("a", "b", F.when(ends, F.col("a")).otherwise(F.col("b")).alias("ja"), F.when(ends, F.col("b")).otherwise(F.col("c")).alias("jb"), F.when(ends, 0).otherwise(1).cast("long").alias("far"), ends.alias("done"), F.col("a").alias("low"))
    state, reach, before = stored(state, "walk"), 1, -1
    while True:
        left = state.where("not done").count()
        if left == 0 or (left == before and reach >= left):
            return state.where("done").select("a", "b", "ja", "jb", "far"), state.where("not done").select("a", "b", "low")
        before, reach = left, reach * 2
        then = state.select(F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("ka"), F.col("jb").alias("kb"), F.col("far").alias("more"), F.col("done").alias("over"), F.col("low").alias("deep"))
        moved = state.where("not done").join(then, ["ja", "jb"]).select("a", "b", F.col("ka").alias("ja"), F.col("kb").alias("jb"), (F.col("far") + F.col("more")).alias("far"), F.col("over").alias("done"), F.least("low", "deep").alias("low"))
        state = stored(state.where("done").unionByName(moved), "walk")


def compress(edges: DataFrame) -> DataFrame:
    """Chains of nodes of degree 2 between junctions (degree 3 or more) become one edge: region, u, v, nodes, length.

    A second edge between the same junctions is split at its middle node; a chain back to its own start is a loop edge;
    chains that start or end at a dead end keep it as their end; edges of parts without a junction stay as they are. All chains
    are followed at once by doubling, so no region has to fit into a task. Of repeated edges the longest counts.
    """
    node = lambda c: F.struct("region", F.col(c).alias("node"))
    sides = edges.where("u <> v").select("region", "u", "v", "length")
    both = sides.unionByName(sides.select("region", F.col("v").alias("u"), F.col("u").alias("v"), "length"))
    both = stored(both.select(node("u").alias("a"), node("v").alias("b"), "length").groupBy("a", "b").agg(F.max("length").alias("length")), "sides")
    degree = stored(both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi")), "degrees")
    inner = degree.where("n = 2").select(F.col("a").alias("b"), "lo", "hi")
    walked, rings = walked_steps(both.join(inner, "b", "left").select("a", "b", F.when(F.col("lo") == F.col("a"), F.col("hi")).otherwise(F.col("lo")).alias("c")))

    steps = F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("k"), F.col("a.node").alias("node"), "length")))
    lines = walked.join(both, ["a", "b"]).groupBy("ja", "jb").agg(steps.alias("s"))
    lines = lines.select(F.col("jb.region").alias("region"), F.concat(F.transform("s", lambda s: s["node"]), F.array("jb.node")).alias("nodes"), F.transform("s", lambda s: s["length"]).alias("parts"))
    at = {"u": 1, "second": 2, "before": -2, "v": -1}
    lines = lines.withColumns({k: F.element_at("nodes", i) for k, i in at.items()})
    junction = degree.select(F.col("a.region").alias("region"), F.col("a.node").alias("node"), (F.col("n") > 2).alias("junction"))
    for end in ("u", "v"):
        lines = lines.join(junction.withColumnsRenamed({"node": end, "junction": f"{end}_junction"}), ["region", end])
    lines = stored(lines, "lines")

    # Each chain is told once: from its junction, of two from the lesser one, a loop by the lesser neighbour.
    chains = lines.where("u_junction and (not v_junction or struct(u, second) <= struct(v, before))")
    again = F.row_number().over(Window.partitionBy("region", F.least("u", "v"), F.greatest("u", "v")).orderBy("u", "second")) > 1
    size = F.size("nodes")
    mid = F.floor(size / 2).cast("int")
    piece = lambda start, n: F.struct(F.slice("nodes", start, n + 1).alias("nodes"), F.slice("parts", start, n).alias("parts"))
    pieces = F.when(again & (size > 2), F.array(piece(F.lit(1), mid), piece(mid + 1, size - 1 - mid))).otherwise(F.array(piece(F.lit(1), size - 1)))
    pieces = chains.select("region", pieces.alias("p")).select("region", F.explode("p").alias("p")).select("region", "p.nodes", F.aggregate("p.parts", F.lit(0.0), lambda t, d: t + d).alias("length"))

    alone = lines.where("not u_junction and not v_junction").select("region", F.posexplode("parts").alias("k", "length"), "nodes").select("region", F.slice("nodes", F.col("k") + 1, 2).alias("nodes"), "length")
    alone = alone.unionByName(rings.join(both, ["a", "b"]).select("a.region", F.array("a.node", "b.node").alias("nodes"), "length")).where("nodes[0] < nodes[1]")
    return pieces.unionByName(alone).select("region", F.element_at("nodes", 1).alias("u"), F.element_at("nodes", -1).alias("v"), "nodes", "length")


def shortest(near: dict, source, limit: float = float("inf")) -> dict:
    """Distances from source by Dijkstra's algorithm, all of those up to limit. near: node -> {node: weight}."""
    best, heap = {source: 0}, [(0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > limit:
            break
        if d > best[n]:
            continue
        for m, w in near.get(n, {}).items():
            if d + w < best.get(m, float("inf")):
                best[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return best


def neighbours(pdf: pd.DataFrame, weight: str) -> dict:
    near: dict = {}
    for u, v, w in zip(pdf.u, pdf.v, pdf[weight], strict=True):
        for a, b in ((u, v), (v, u)):
            if w < near.setdefault(a, {}).get(b, float("inf")):
                near[a][b] = w
    return near


def distances_cm(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """region, source, node, cm: whole centimetres (edge lengths are cut first); unreachable nodes have -1."""
    tagged = edges.select("region", "u", "v", (F.col("length") * 100).cast("bigint").alias("cm"), F.lit(None).cast("long").alias("source"))
    both = tagged.unionByName(sources.select("region", F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("cm"), F.col("source")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf.u.notna()].astype({"u": "int64", "v": "int64", "cm": "int64"})
        near, rows = neighbours(e, "cm"), []
        for s in sorted(pdf.source.dropna().astype("int64")):
            best = shortest(near, s)
            rows += [(int(pdf.region.iloc[0]), int(s), int(n), int(best.get(n, -1))) for n in sorted(near)]
        return pd.DataFrame(rows, columns=["region", "source", "node", "cm"])

    return both.groupBy("region").applyInPandas(run, "region long, source long, node long, cm long")


def to_pixel_adjacency(edges: DataFrame, box: tuple[float, float, float, float], size: int) -> DataFrame:
    """region, row, col, neighbours (array of struct(row, col)): the ends of edges as pixels of the box to a thousandth; inner
    vertices are left out, loops go, edges between the same pixels are one, and each is told from both ends."""
    b = F.struct(*[F.lit(v).alias(k) for k, v in zip(("min_lat", "min_lng", "max_lat", "max_lng"), box, strict=True)])

    def at(i: int) -> Column:
        row, col = geo.geo_to_rc(F.element_at("coords", i)["lat"], F.element_at("coords", i)["lng"], b, size)
        return F.struct(F.bround(row, 3).alias("row"), F.bround(col, 3).alias("col"))

    e = edges.select("region", at(1).alias("p"), at(-1).alias("q")).where("p <> q")
    both = e.union(e.select("region", "q", "p")).distinct()
    return both.groupBy("region", "p").agg(F.array_sort(F.collect_set("q")).alias("neighbours")).select("region", "p.row", "p.col", "neighbours")


def read_pixel_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """region, r1, c1, r2, c2: one row for each direction of each edge of stored adjacency lists."""
    a = spark.read.parquet(path).select("region", F.col("row").alias("r1"), F.col("col").alias("c1"), F.explode("neighbours").alias("q"))
    return a.select("region", "r1", "c1", F.col("q.row").alias("r2"), F.col("q.col").alias("c2"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """region, node, label: the least node that links (region, node, other) lead to, over any number of them and in any direction.

    Rounds of joins, by Kiveris and others (2014): each node ties its greater neighbours to the least node it knows, then itself
    and its lesser ones. Links turn into stars; the number of rounds grows with the logarithm of the longest way.
    """
    two = lambda a, b: F.struct(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
    now = stored(links.where("node <> other").select("region", two("node", "other").alias("s")).select("region", "s.*").distinct(), "stars")
    seen = None
    while True:
        facts = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("region", "node", "other").cast("decimal(38,0)"))).first()  # one row
        if facts == seen or not facts[0]:
            break
        seen = facts
        both = now.unionByName(now.select("region", F.col("other").alias("node"), F.col("node").alias("other")))
        least = both.groupBy("region", "node").agg(F.min("other").alias("least")).withColumn("least", F.least("least", "node"))
        # The greater neighbours of a node are those that tell it as their lesser one.
        large = now.select("region", F.col("other").alias("node"), F.col("node").alias("far")).join(least, ["region", "node"])
        large = stored(large.select("region", F.col("far").alias("node"), F.col("least").alias("other")).distinct(), "stars")
        least = large.groupBy("region", "node").agg(F.min("other").alias("least"))
        small = large.join(least, ["region", "node"]).select("region", F.explode(F.array("node", "other")).alias("node"), F.col("least").alias("other"))
        now = stored(small.where("node <> other").distinct(), "stars")
    return nodes.join(now.withColumnRenamed("other", "label"), ["region", "node"], "left").withColumn("label", F.coalesce("label", "node"))
