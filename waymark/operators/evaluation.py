"""Map-quality metrics: one kernel per region and direction, in a fixed order; means and summaries as aggregates."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .network import neighbours, shortest

DEGREE_M = 111111.0
#: Metres along the map within which no second control point is snapped.
APART_M = 8.0


#: Nodes up to which all distances are found at once, by one array operation for each node.
DENSE = 300


def between(near: dict, nodes: list) -> np.ndarray:
    """Distances between all of some nodes, inf where there is no way."""
    if len(near) > DENSE:
        rows = {p: shortest(near, p) for p in set(nodes)}
        return np.array([[rows[p].get(q, math.inf) for q in nodes] for p in nodes])
    index = {n: k for k, n in enumerate(near)}
    d = np.full((len(near), len(near)), math.inf)
    np.fill_diagonal(d, 0.0)
    for u, to in near.items():
        for v, w in to.items():
            if u != v:
                d[index[u], index[v]] = w
    for k in range(len(near)):
        np.minimum(d, d[:, k, None] + d[k], out=d)
    at = [index[n] for n in nodes]
    return d[np.ix_(at, at)]


def _metres(a, b) -> float:
    return math.hypot(a[0] - b[0], (a[1] - b[1]) * math.cos(math.radians(a[0]))) * DEGREE_M


def control_points(near: dict, at: dict, long_chain: int = 15, share: float = 10.0) -> list:
    """Junctions and ends, and points at even steps along long chains; in node order."""
    points, seen = [], set()
    for n in sorted(near):
        if len(near[n]) == 2:
            continue
        points.append(n)
        for m in sorted(near[n]):
            if m in seen:
                continue
            chain = [n, m]
            while len(near[chain[-1]]) == 2 and chain[-1] != n:
                chain.append(next(x for x in sorted(near[chain[-1]]) if x != chain[-2]))
            if len(chain) > long_chain:
                k = int(len(chain) / share) + 1
                points += [chain[int(len(chain) * i / k)] for i in range(1, k)]
            seen.update(chain[1:-1])
    return sorted(set(points))


def apls_one_way(truth: pd.DataFrame, pred: pd.DataFrame, at: dict, snap_m: float = 10.0, least_m: float = 0.0, at_pred: dict | None = None) -> float | None:
    """1 minus the mean relative error of path lengths between control points of truth; a point without its like in pred
    counts as 1 with every other. None without pairs."""
    a, b = neighbours(truth, "length"), neighbours(pred, "length")
    there = at if at_pred is None else at_pred
    points, taken, snapped = control_points(a, at), set(), {}  # snapped: point to its like in pred
    rows: dict = {}
    for n in b:
        rows.setdefault(math.floor(there[n][0] * DEGREE_M / snap_m), []).append(n)
    for p in points:
        k = math.floor(at[p][0] * DEGREE_M / snap_m)
        near = sorted((_metres(there[n], at[p]), n) for d in (-1, 0, 1) for n in rows.get(k + d, ()) if abs(there[n][0] - at[p][0]) * DEGREE_M < snap_m)
        for d, n in near:
            if n not in taken and d < snap_m:
                snapped[p] = n
                taken |= {m for m, far in shortest(b, n, APART_M).items() if far <= APART_M}
                break
    if len(points) < 2:
        return None
    at_b = [snapped.get(p, points[0]) for p in points]
    there_is = np.array([p in snapped for p in points])
    # Without a like of either end a pair counts as 1; of the others those that truth joins over more than least_m.
    i, j = np.triu_indices(len(points), 1)
    both = there_is[i] & there_is[j]
    d1 = between(a, points)[i, j][both]
    known = between(b, [at_b[k] for k in np.flatnonzero(there_is)]) if there_is.any() else np.zeros((0, 0))
    place = np.cumsum(there_is) - 1
    d2 = known[place[i[both]], place[j[both]]]
    counted = np.isfinite(d1) & (d1 > least_m)
    d1, d2 = d1[counted], np.where(np.isfinite(d2[counted]), d2[counted], 0.0)
    n = int((~both).sum()) + len(d1)
    return 1 - float((~both).sum() + np.minimum(np.abs(d1 - d2) / d1, 1.0).sum()) / n if n else None


def _both(truth: DataFrame, pred: DataFrame, nodes: DataFrame, pred_nodes: DataFrame | None = None) -> DataFrame:
    e = lambda df, kind: df.select("region", F.lit(kind).alias("kind"), "u", "v", "length", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    n = lambda df, kind: df.select("region", F.lit(kind).alias("kind"), F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("length"), "lat", "lng")
    both = e(truth, "truth").unionByName(e(pred, "pred")).unionByName(n(nodes, "node"))
    return both if pred_nodes is None else both.unionByName(n(pred_nodes, "pred_node"))


def _places(pdf: pd.DataFrame) -> tuple[dict, dict]:
    """Places of the nodes of truth and of pred; without nodes of its own, pred has those of truth."""
    at = lambda kind: {n: (y, x) for n, y, x in pdf.loc[pdf.kind == kind, ["u", "lat", "lng"]].itertuples(index=False)}
    own = at("node")
    return own, at("pred_node") or own


def apls(truth: DataFrame, pred: DataFrame, nodes: DataFrame, snap_m: float = 10.0, pred_nodes: DataFrame | None = None) -> DataFrame:
    """region, forward, backward, apls (their mean; null if either is). pred_nodes: if the maps number their nodes apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, there = _places(pdf)
        t, p = pdf[pdf.kind == "truth"], pdf[pdf.kind == "pred"]
        a, b = apls_one_way(t, p, at, snap_m, at_pred=there), apls_one_way(p, t, there, snap_m, at_pred=at)
        return pd.DataFrame([(int(pdf.region.iloc[0]), a, b, (a + b) / 2 if a is not None and b is not None else None)], columns=["region", "forward", "backward", "apls"])

    return _both(truth, pred, nodes, pred_nodes).groupBy("region").applyInPandas(run, "region long, forward double, backward double, apls double")


def walk(near: dict, at: dict, start, radius: float, step: float) -> list[tuple[float, float]]:
    """Points at every step along all edges within a radius (metres) of a start node."""
    best, out = shortest(near, start, radius), []
    for u, v in sorted({(min(n, m), max(n, m)) for n, d in best.items() if d <= radius for m in near.get(n, ())}):
        w = near[u][v]
        a, b = (u, v) if best.get(u, math.inf) <= best.get(v, math.inf) else (v, u)
        d = best[a]
        k = math.ceil(d / step)
        while k * step <= min(d + w, radius):
            r = (k * step - d) / w if w else 0.0
            out.append((at[a][0] + r * (at[b][0] - at[a][0]), at[a][1] + r * (at[b][1] - at[a][1])))
            k += 1
    return out


def close_pairs(marbles: list[tuple[float, float]], holes: list[tuple[float, float]], threshold: float) -> list[tuple[int, int, float]]:
    """Numbers of all places of both within a threshold of each other, in order, with their distance."""
    order = sorted(range(len(holes)), key=lambda j: holes[j][0])
    lats, room = [holes[j][0] for j in order], threshold / DEGREE_M * (1 + 1e-9)
    out = []
    for i, m in enumerate(marbles):
        wide = room / max(math.cos(math.radians(m[0])), 1e-12)
        near = sorted(j for j in order[bisect.bisect_left(lats, m[0] - room) : bisect.bisect_right(lats, m[0] + room)] if abs(holes[j][1] - m[1]) <= wide)
        out += [(i, j, d) for j in near if (d := _metres(m, holes[j])) <= threshold]
    return out


def maximum_matching(near: dict) -> int:
    """Size of a maximum bipartite matching: augmenting paths layer by layer (Hopcroft and Karp, 1973). near: left -> rights."""
    left, right = {}, {}
    while True:
        layer = {u: 0 for u in near if u not in left}
        queue, found = list(layer), False
        for u in queue:
            for v in near[u]:
                w = right.get(v)
                if w is None:
                    found = True
                elif w not in layer:
                    layer[w] = layer[u] + 1
                    queue.append(w)
        if not found:
            return len(left)
        for root in [u for u in near if u not in left]:
            path, tries = [root], {root: iter(near[root])}
            back = {}
            while path:
                u = path[-1]
                v = next(tries[u], None)
                if v is None:
                    layer.pop(u, None)
                    path.pop()
                    continue
                w = right.get(v)
                if w is None:
                    back[u] = v
                    for x in reversed(path):
                        left[x], right[back[x]] = back[x], x
                    break
                if layer.get(w) == layer.get(u, -2) + 1 and w not in tries:
                    back[u] = v
                    path.append(w)
                    tries[w] = iter(near[w])


def greedy_matching(pairs: list[tuple]) -> tuple[int, float]:
    """Number and cost of pairs (left, right, cost) taken by rising cost."""
    a, b, cost = set(), set(), 0.0
    for u, v, c in sorted(pairs, key=lambda p: p[2]):
        if u not in a and v not in b:
            a.add(u)
            b.add(v)
            cost += c
    return len(a), cost


def topo(truth: DataFrame, pred: DataFrame, nodes: DataFrame, radius: float = 600.0, step: float = 40.0, threshold: float = 20.0, near_m: float = 30.0, pred_nodes: DataFrame | None = None) -> DataFrame:
    """region, start, precision, recall, matched, greedy: from each junction or end of truth that lies on pred too, points
    are dropped along both maps and matched one to one within a threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, there = _places(pdf)
        a, b = (neighbours(pdf[pdf.kind == k], "length") for k in ("truth", "pred"))
        rows = []
        for s in sorted(n for n in a if len(a[n]) != 2):
            own = min(((_metres(there[n], at[s]), n) for n in b), default=(math.inf, None))
            if own[0] > near_m:
                continue
            holes, marbles = walk(a, at, s, radius, step), walk(b, there, own[1], radius, step)
            pairs = close_pairs(marbles, holes, threshold)
            near: dict = {}
            for i, j, _ in pairs:
                near.setdefault(i, []).append(j)
            n = maximum_matching(near)
            rows.append((int(pdf.region.iloc[0]), int(s), n / len(marbles) if marbles else 0.0, n / len(holes) if holes else 0.0, n, greedy_matching(pairs)[0]))
        return pd.DataFrame(rows, columns=["region", "start", "precision", "recall", "matched", "greedy"])

    return _both(truth, pred, nodes, pred_nodes).groupBy("region").applyInPandas(run, "region long, start long, precision double, recall double, matched long, greedy long")


def location_distance(near: dict, p: tuple, q: tuple, limit: float) -> float | None:
    """Metres along the map between two places (u, v, metres to u, metres to v) on edges; None beyond a limit."""
    ways = []
    if {p[0], p[1]} == {q[0], q[1]}:
        ways.append(abs(p[2] - (q[2] if p[0] == q[0] else q[3])))
    for a, da in ((p[0], p[2]), (p[1], p[3])):
        if da <= limit:
            to = shortest(near, a, limit - da)
            ways += [da + to[b] + db for b, db in ((q[0], q[2]), (q[1], q[3])) if b in to]
    return min((w for w in ways if w <= limit), default=None)


def thin_results(scores: DataFrame, edges: DataFrame, apart_m: float = 22.0, good: float = 0.9) -> DataFrame:
    """scores (region, start, precision and others) without those that a better one replaces: by falling precision (ties by
    start), each kept start replaces the starts less than apart_m away along the map (edges: region, u, v, length), unless their
    precision is good. Null precisions come last."""
    scores = stored(scores, "scores")  # read twice
    rows = scores.select("region", F.col("start").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("length"), "precision")
    both = rows.unionByName(edges.select("region", "u", "v", "length", F.lit(None).cast("double").alias("precision")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf.v.notna()].astype({"v": "int64"})
        near, replaced, kept = neighbours(e, "length"), set(), []
        for s, p in pdf[pdf.v.isna()].sort_values(["precision", "u"], ascending=[False, True], na_position="last")[["u", "precision"]].itertuples(index=False):
            if s in replaced and not p >= good:
                continue
            kept.append((int(pdf.region.iloc[0]), int(s)))
            replaced |= {n for n, d in shortest(near, s, apart_m).items() if d < apart_m}
        return pd.DataFrame(kept, columns=["region", "start"])

    return scores.join(both.groupBy("region").applyInPandas(run, "region long, start long").distinct(), ["region", "start"], "left_semi")


def macro_f1(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F1 of mean precision and mean recall over rows whose sum of both is positive, with counts."""
    ok = F.coalesce((F.col("precision") + F.col("recall")) > 0, F.lit(False)) & ~F.isnan("precision") & ~F.isnan("recall")
    g = scores.groupBy(*(by or [])).agg(F.avg(F.when(ok, F.col("precision"))).alias("precision"), F.avg(F.when(ok, F.col("recall"))).alias("recall"), F.sum(ok.cast("long")).alias("evaluated"), F.sum((~ok).cast("long")).alias("skipped"))
    p, r = F.col("precision"), F.col("recall")
    return g.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)))


def early_stopping(epochs: DataFrame, patience: int) -> DataFrame:
    """run, epoch, f1 with best (so far) and counter; equal scores neither reset nor count; stopped once counter reaches patience."""
    g = epochs.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "f1"))).alias("e"))

    def step(acc, x):
        up, down = x["f1"] > acc["best"], x["f1"] < acc["best"]
        best, n = F.when(up, x["f1"]).otherwise(acc["best"]), F.when(up, 0).when(down, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(best.alias("best"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(x["epoch"].alias("epoch"), x["f1"].alias("f1"), best.alias("best"), n.alias("counter")))).alias("out"))

    state = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("n"), F.array().cast("array<struct<epoch:int,f1:double,best:double,counter:int>>").alias("out"))
    return g.select("run", F.explode(F.aggregate("e", state, step, lambda a: a["out"])).alias("x")).select("run", "x.*", (F.col("x.counter") >= patience).alias("stopped"))
