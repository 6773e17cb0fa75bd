"""Map matching: candidates, their probabilities and the routes between them as joins, then a hidden Markov model in chunks.

`Routes` and `viterbi` answer for one trajectory in one process what `match` does with tables; the tests compare both.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import stored
from . import routing, spatial
from . import viterbi as viterbi_chunks
from .network import shortest

SIGMA, BETA = 50.0, 2.0
NEVER = float("-inf")


def emission(error: Column, sigma: float = SIGMA) -> Column:
    return F.lit(math.log(1.0 / (math.sqrt(2.0 * math.pi) * sigma))) - 0.5 * F.pow(error / sigma, 2)


def transition(route: Column, straight: Column, beta: float = BETA) -> Column:
    return F.lit(math.log(1.0 / beta)) - F.abs(straight - route) / beta


class Routes:
    """Shortest routes between candidates (u, v, length, eid, offset). On a directed network edges run from u to v, offsets from
    u; on one edge only a growing offset is a way."""

    def __init__(self, edges: pd.DataFrame, directed: bool = False):
        self.directed = directed
        self.near: dict = {}
        self.into: dict = {}
        self.eid: dict = {}
        for e, u, v, d in zip(edges.eid, edges.u, edges.v, edges.length, strict=True):
            for a, b in ((u, v),) if directed else ((u, v), (v, u)):
                if d < self.near.setdefault(a, {}).get(b, float("inf")):
                    self.near[a][b] = self.into.setdefault(b, {})[a] = d
                    self.eid[a, b] = e
        self.known: dict = {}

    def from_node(self, n) -> dict:
        if n not in self.known:
            self.known[n] = shortest(self.near, n)
        return self.known[n]

    def best(self, p: dict, q: dict) -> tuple[float, tuple | None]:
        """Metres, and the ends between which the route runs; None on one edge; inf if there is no way."""
        if p["eid"] == q["eid"]:
            on = q["offset"] - p["offset"]
            return (on if on > 0 else float("inf")) if self.directed else abs(on), None
        ways, ahead, start = [], [(p["v"], p["length"] - p["offset"])], [(q["u"], q["offset"])]
        if not self.directed:
            ahead, start = [(p["u"], p["offset"]), *ahead], [*start, (q["v"], q["length"] - q["offset"])]
        for a, da in ahead:
            to = self.from_node(a)
            ways += [(da + to[b] + db, (a, b, da, db)) for b, db in start if b in to]
        return min(ways, key=lambda w: w[0], default=(float("inf"), None))

    def nodes(self, a, b) -> list:
        """Nodes of the shortest way from a to b, walked back along decreasing distances; ties by node."""
        to, out = self.from_node(a), [b]
        while out[-1] != a:
            n = out[-1]
            out.append(min(m for m, w in self.into[n].items() if m in to and abs(to[m] + w - to[n]) < 1e-6))
        return out[::-1]


def viterbi(steps: list[list[dict]], straight: list[float], routes: Routes, sigma: float = SIGMA, beta: float = BETA) -> list[dict | None]:
    """The most likely candidate of each step. A step without candidates has none and ends the chain; a step that no route
    reaches starts a new one. Of equal scores the first wins."""
    out: list[dict | None] = []
    chain: list[tuple[list[dict], list[float], list[int]]] = []
    emit = lambda c: math.log(1.0 / (math.sqrt(2.0 * math.pi) * sigma)) - 0.5 * (c["error"] / sigma) ** 2

    def close():
        if not chain:
            return
        picked, k = [], max(range(len(chain[-1][1])), key=lambda i: chain[-1][1][i])
        for cands, _, back in reversed(chain):
            picked.append(cands[k])
            k = back[k]
        out.extend(reversed(picked))
        chain.clear()

    for t, cands in enumerate(steps):
        if not cands:
            close()
            out.append(None)
            continue
        if chain:
            before, scores, _ = chain[-1]
            best = [max(((scores[i] - math.log(beta) - abs(straight[t] - routes.best(p, q)[0]) / beta, -i) for i, p in enumerate(before)), default=(NEVER, 0)) for q in cands]
            if any(b[0] > NEVER for b in best):
                chain.append((cands, [b[0] + emit(q) for b, q in zip(best, cands, strict=True)], [-b[1] for b in best]))
                continue
            close()
        chain.append((cands, [emit(q) for q in cands], [0] * len(cands)))
    close()
    return out


def network_nodes(edges: DataFrame) -> DataFrame:
    """node, lat, lng from the ends of the edges' coords."""
    end = lambda n, at: edges.select(F.col(n).alias("node"), F.element_at("coords", at).alias("p"))
    ends = end("u", 1).unionByName(end("v", -1))
    return ends.groupBy("node").agg(F.min("p").alias("p")).select("node", "p.lat", "p.lng")


CANDIDATE = ("eid", "u", "v", "length", "error", "offset", "proj_lat", "proj_lng")


def _ways(p: Column, q: Column, directed: bool) -> Column:
    """The ends between which a route from candidate p to candidate q on another edge may run: k, a, b, metres before and after."""
    way = lambda k, a, da, b, db: F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b"), da.alias("da"), db.alias("db"))
    ahead, start = [(p["v"], p["length"] - p["offset"])], [(q["u"], q["offset"])]
    if not directed:
        ahead, start = [(p["u"], p["offset"]), *ahead], [*start, (q["v"], q["length"] - q["offset"])]
    return F.array(*[way(k, a, da, b, db) for k, ((a, da), (b, db)) in enumerate((x, y) for x in ahead for y in start)])


#: Names for the nodes at the ends of the edges of p and q.
ENDS = (("p_u", "p", "u"), ("p_v", "p", "v"), ("q_u", "q", "u"), ("q_v", "q", "v"))


def _ahead(moves: DataFrame, edges: DataFrame, directed: bool, bounds: tuple[float, ...], with_nodes: bool = False) -> tuple[DataFrame, DataFrame]:
    """p_u, p_v, q_u, q_v and d0, d1, ...: metres of the routes between the ends of the edges of p and q, in the order of _ways, null
    where there is none; and the routes. One row for each four nodes, however many moves (p, q) lie between their edges."""
    ends = stored(moves.select(*[F.col(f"{x}.{n}").alias(c) for c, x, n in ENDS]).distinct(), "ends")
    names = [c for c, _, _ in ENDS]
    between = [("p_v", "q_u")] if directed else [(a, b) for a in ("p_u", "p_v") for b in ("q_u", "q_v")]
    ways = ends.select(*names, F.posexplode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in between])).alias("k", "w")).select(*names, "k", "w.*")
    routes = stored(routing.distances(ways, edges, network_nodes(edges), directed, with_nodes=with_nodes, bounds=bounds), "routes")
    found = ways.join(routes.select("a", "b", "dist"), ["a", "b"]).groupBy(*names)
    return stored(found.agg(*[F.max(F.when(F.col("k") == k, F.col("dist"))).alias(f"d{k}") for k in range(len(between))]), "ahead"), routes


def _chained(found: DataFrame, points: DataFrame) -> DataFrame:
    """Each object's points in order of time: t from 0, cands (by edge), before (those of the point before), straight metres from it."""
    cands = found.groupBy("oid", "seq").agg(F.array_sort(F.collect_list(F.struct(*CANDIDATE))).alias("cands"))
    none = F.array().cast(cands.schema["cands"].dataType)
    w = Window.partitionBy("oid").orderBy("time", "seq")
    out = points.select("oid", "seq", "time", "lat", "lng").join(cands, ["oid", "seq"], "left").withColumn("cands", F.coalesce("cands", none))
    lat, lng = F.lag("lat").over(w), F.lag("lng").over(w)
    out = out.withColumns({"t": (F.row_number().over(w) - 1).cast("long"), "before": F.coalesce(F.lag("cands").over(w), none), "straight": geo.haversine_m(lat, lng, F.col("lat"), F.col("lng"))})
    return out


def match(points: DataFrame, edges: DataFrame, search_m: float = SIGMA, directed: bool = False, chunk: int = viterbi_chunks.CHUNK, bounds: tuple[float, ...] = routing.BOUNDS) -> DataFrame:
    """points with eid, u, v, length, error, offset, proj_lat, proj_lng: null where nothing matches. One row per point.

    On a directed network a point that does not move on along its edge starts anew. Routes between the candidates of neighbouring
    points may go anywhere in the network, and an object's points are matched in chunks, so neither has to fit a task.
    """
    found = spatial.candidates(points.select("oid", "seq", "time", "lat", "lng"), edges, search_m)
    steps = stored(_chained(found, points), "chains")
    place = lambda c: F.struct(*[F.col(f"{c}.{k}") for k in ("eid", "u", "v", "length", "offset")])
    pairs = steps.select("oid", "t", "straight", F.posexplode("before").alias("i", "p"), "cands").select("oid", "t", "straight", "i", place("p").alias("p"), F.posexplode("cands").alias("j", "q")).withColumn("q", place("q"))
    on = F.col("q.offset") - F.col("p.offset")
    same = F.when(on > 0, on) if directed else F.abs(on)
    other = F.col("p.eid") != F.col("q.eid")
    ahead, _ = _ahead(pairs.where(other), edges, directed, bounds)
    pairs = pairs.withColumns({c: F.when(other, F.col(f"{x}.{n}")) for c, x, n in ENDS})
    moves = pairs.join(ahead, [c for c, _, _ in ENDS], "left")
    ways = _ways(F.col("p"), F.col("q"), directed)
    total = [ways[k]["da"] + F.col(f"d{k}") + ways[k]["db"] for k in range(1 if directed else 4)]
    route = total[0] if directed else F.least(*total)
    score = viterbi_chunks.scaled(transition(F.when(other, route).otherwise(same), F.col("straight")))
    moves = moves.groupBy("oid", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", score.alias("score")))), lambda m: m["score"]).alias("move"))
    emitted = F.transform("cands", lambda c: viterbi_chunks.scaled(emission(c["error"])))
    chains = steps.select("oid", "t", F.size("before").alias("n_before"), emitted.alias("emission")).join(moves, ["oid", "t"], "left")
    states = viterbi_chunks.most_likely(chains.withColumn("move", F.coalesce("move", F.array().cast("array<long>"))), chunk)
    out = steps.join(states, ["oid", "t"]).withColumn("c", F.get("cands", F.col("state")))
    return out.select("oid", "seq", "time", "lat", "lng", *[F.col(f"c.{c}").alias(c) for c in CANDIDATE])


def to_paths(matched: DataFrame, edges: DataFrame, directed: bool = False, bounds: tuple[float, ...] = routing.BOUNDS) -> DataFrame:
    """oid, path, pos, eid, enter_time, leave_time: the edges that a matched trajectory travels, times shared by distance.

    Gaps split paths, and on a directed network standing still or going back on an edge; paths of two edges or fewer are dropped.
    A visit is a run of points on one edge; the route from the visit before it gives the edges in between and the times at which
    both edges are left and entered. All steps are windows over an object's rows, or joins.
    """
    w = Window.partitionBy("oid").orderBy("time", "seq")
    place = F.struct("eid", "u", "v", "length", "offset", F.unix_micros("time").alias("time"))
    rows = matched.withColumns({"q": place, "p": F.lag(place).over(w), "t": F.row_number().over(w)}).where("q.eid is not null").select("oid", "t", "p", "q")
    linked = F.col("p.eid").isNotNull()
    back = (F.col("p.eid") == F.col("q.eid")) & (F.col("q.offset") <= F.col("p.offset")) if directed else F.lit(False)
    rows = stored(rows.withColumns({"moved": linked & (F.col("p.eid") != F.col("q.eid")), "cut": ~linked | back}), "rows")
    ahead, routes = _ahead(rows.where("moved"), edges, directed, bounds, with_nodes=True)
    rows = rows.withColumns({c: F.when(F.col("moved"), F.col(f"{x}.{n}")) for c, x, n in ENDS}).join(ahead, [c for c, _, _ in ENDS], "left")
    ways = _ways(F.col("p"), F.col("q"), directed)
    ways = [ways[k] for k in range(1 if directed else 4)]
    total = [F.struct((w["da"] + F.col(f"d{k}") + w["db"]).alias("total"), *[w[c].alias(c) for c in ("k", "a", "b", "da", "db")]) for k, w in enumerate(ways)]
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"d{k}").isNotNull(), t) for k, t in enumerate(total)])))
    rows = rows.withColumn("w", F.when(F.col("moved"), best)).select("oid", "t", "p", "q", "moved", (F.col("cut") | (F.col("moved") & F.col("w").isNull())).alias("cut"), "w.total", "w.a", "w.b", "w.da", "w.db")
    runs = Window.partitionBy("oid").orderBy("t")
    rows = rows.withColumns({"path": F.sum(F.col("cut").cast("long")).over(runs), "visit": F.sum((F.col("cut") | F.col("moved")).cast("long")).over(runs)})
    head = F.struct("t", F.col("p.time").alias("before"), F.col("q.time").alias("time"), F.when(F.col("cut"), F.lit(None)).otherwise(F.col("total")).alias("total"), "a", "b", "da", "db")
    visits = rows.groupBy("oid", "path", "visit").agg(F.first("q.eid").alias("eid"), F.min(head).alias("h"), F.max("q.time").alias("last")).select("oid", "path", "visit", "eid", "h.*", "last")
    span = F.col("time") - F.col("before")
    at = lambda metres: F.col("before") + F.when(F.col("total") > 0, F.floor(span * metres / F.col("total")).cast("long")).otherwise(span)
    visits = stored(visits.withColumns({"enter": F.when(F.col("total").isNull(), F.col("time")).otherwise(at(F.col("total") - F.col("db"))), "left": F.when(F.col("total").isNotNull(), at(F.col("da")))}), "visits")
    own = visits.select("oid", "path", "visit", F.lit(1 << 30).alias("k"), "eid", "enter", F.coalesce(F.lead("left").over(Window.partitionBy("oid", "path").orderBy("visit")), F.col("last")).alias("leave"))
    between = visits.where("total is not null").join(routes.select("a", "b", "via"), ["a", "b"])
    between = between.withColumn("x", F.explode(F.arrays_zip(F.slice("via", 1, F.size("via") - 1).alias("a"), F.slice("via", 2, F.size("via") - 1).alias("b"), F.sequence(F.lit(1), F.size("via")).alias("k")))).where("x.b is not null")
    ways = routing.steps(edges, directed).select("a", "b", F.col("eid").alias("way"), "length")
    between = between.drop("a", "b").withColumns({"a": F.col("x.a"), "b": F.col("x.b"), "k": F.col("x.k")}).join(ways, ["a", "b"])
    done = F.sum("length").over(Window.partitionBy("oid", "visit").orderBy("k"))
    between = between.withColumn("done", F.col("da") + done).select("oid", "path", "visit", "k", F.col("way").alias("eid"), at(F.col("done") - F.col("length")).alias("enter"), at(F.col("done")).alias("leave"))
    pieces = own.unionByName(between)
    one = Window.partitionBy("oid", "path")
    pieces = pieces.withColumns({"pos": F.row_number().over(one.orderBy("visit", "k")) - 1, "n": F.count(F.lit(1)).over(one)}).where("n > 2")
    number = F.dense_rank().over(Window.partitionBy("oid").orderBy("path")) - 1
    return pieces.select("oid", number.cast("int").alias("path"), F.col("pos").cast("int").alias("pos"), "eid", F.timestamp_micros("enter").alias("enter_time"), F.timestamp_micros("leave").alias("leave_time"))
