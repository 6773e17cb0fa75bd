"""Hard-negative mining with an STR-packed R-tree over integer vectors.

Sort-tile-recursive packing: Spark sorts the rows by the first coordinate and cuts slabs, sorts each slab by the second one and
cuts tiles of TILE_ROWS rows; within a tile, tasks go on with the next coordinates down to leaves of LEAF_ROWS rows. Above the
leaves stand boxes of FAN_OUT children. A box has the least and the largest value of each coordinate, which bound the inner
product of its rows with an anchor from both sides, and the smallest identifier in it, which settles ties.

A search keeps a queue of boxes in order of their upper bound (no higher than the window of scores asked for). A box goes if
its bounds miss the window, or if the best its rows could do comes strictly after the kth row found. Each anchor searches its
own tile first; its kth row there prunes the other tiles. Anchors are dealt over blocks of ANCHOR_BLOCK, and a task holds one
tile and one block. The result is that of comparing every anchor with every row, for any data; the boxes only save work.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a component that is
missing in a shorter vector is 0. A row with a null identifier is no anchor, and comes last among equal scores. Of rows with
equal identifiers each counts; fully equal rows stand for each other. The largest long as an identifier counts as null. Scores
that exceed a long are held at its ends. Empty
tables and anchors without positives or negatives give no rows; other columns never matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import materialize

TILE_ROWS, LEAF_ROWS, FAN_OUT, ANCHOR_BLOCK = 8192, 64, 8, 4096
#: Leaves that are scored at a time; the number doubles as a search goes on.
FIRST_LEAVES = 4
MOST = (1 << 63) - 1
#: Stands for a null identifier: last in order.
NO_ID = MOST

WINDOWS = "array<struct<slot:int,low:long,high:long,score:long,id:long>>"
FOUND = "anchor long, slot int, score long, row long, id long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times the transpose of b, exact, held within longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -MOST, MOST).astype(np.int64)


def packed(vectors: np.ndarray, leaf_rows: int, first: int = 2) -> np.ndarray:
    """The order of rows in which each leaf_rows of them are a leaf: sort, cut into slabs, and go on with the next coordinate."""
    n, d = vectors.shape
    leaves = -(-n // leaf_rows)
    depth = max(1, min(d, leaves.bit_length() // 2))
    order = np.arange(n)
    parts = [(0, n)]
    for level in range(depth):
        column = vectors[:, (first + level) % d] if d else np.zeros(n)
        after = []
        for lo, hi in parts:
            order[lo:hi] = order[lo:hi][np.argsort(column[order[lo:hi]], kind="stable")]
            pages = -(-(hi - lo) // leaf_rows)
            slabs = max(1, round(pages ** (1 / (depth - level))))
            step = -(-pages // slabs) * leaf_rows
            after += [(k, min(k + step, hi)) for k in range(lo, hi, step)]
        parts = after
    return order


class Tree:
    """The boxes over one tile. Level 0 holds the leaves, each further one a box for every FAN_OUT of the one below."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        order = packed(vectors, leaf_rows)
        self.vectors, self.ids, self.labels, self.rows, self.leaf_rows = vectors[order], ids[order], labels[order], rows[order], leaf_rows
        cut = np.arange(0, len(order), leaf_rows)
        low, high, least = np.minimum.reduceat(self.vectors, cut), np.maximum.reduceat(self.vectors, cut), np.minimum.reduceat(self.ids, cut)
        lows, highs, leasts, self.level_start = [low], [high], [least], [0]
        while len(low) > 1:
            self.level_start.append(self.level_start[-1] + len(low))
            cut = np.arange(0, len(low), FAN_OUT)
            low, high, least = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(least, cut)
            lows.append(low)
            highs.append(high)
            leasts.append(least)
        self.low, self.high, self.least = np.concatenate(lows), np.concatenate(highs), np.concatenate(leasts)
        self.n_leaves = len(lows[0])

    def children(self, box: int) -> range:
        level = np.searchsorted(self.level_start, box, "right") - 1
        first = self.level_start[level - 1] + (box - self.level_start[level]) * FAN_OUT
        return range(first, min(first + FAN_OUT, self.level_start[level]))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that a row of each box can have with each anchor (anchors by boxes)."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        add = lambda p, q: np.where((p > 0) & (q > MOST - p), MOST, np.where((p < 0) & (q < -MOST - p), -MOST, p + q))
        with np.errstate(over="ignore"):
            return add(products(up, self.low), products(down, self.high)), add(products(up, self.high), products(down, self.low))


class Anchor:
    """One anchor's searches in a tree, which share the scores of the leaves they reach."""

    def __init__(self, tree: Tree, vector: np.ndarray, label: object, row: int, same: bool, least: np.ndarray, most: np.ndarray) -> None:
        self.tree, self.vector, self.row, self.low, self.high = tree, vector, row, least.tolist(), most.tolist()
        self.fits = (tree.labels == label) if same else (tree.labels != label)
        self.scores: dict[int, np.ndarray] = {}

    def _scored(self, leaves: list[int]) -> None:
        new, size = [x for x in leaves if x not in self.scores], self.tree.leaf_rows
        if new:
            parts = [self.tree.vectors[x * size : (x + 1) * size] for x in new]
            scores = products(self.vector[None], np.concatenate(parts))[0]
            self.scores.update(zip(new, np.split(scores, np.cumsum([len(p) for p in parts])[:-1])))

    def search(self, low: int, high: int, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int, int]]:
        """The first k rows (score, row, id) with low <= score <= high, none of them after floor, a (score, id)."""
        t = self.tree
        least = t.least
        best: list[tuple[int, int, int]] = []  # (-score, id, place), in order
        last = (-floor[0], floor[1]) if floor else None

        def entry(box: int) -> tuple[int, int, int] | None:
            """What the queue sorts by: the best that the box's rows can do."""
            if self.high[box] < low or self.low[box] > high:
                return None
            e = (-min(self.high[box], high), int(least[box]), box)
            return e if last is None or e[:2] <= last else None

        queue = [e for e in [entry(len(least) - 1)] if e]
        at_once = FIRST_LEAVES
        while queue:
            leaves: list[int] = []
            while queue and len(leaves) < at_once:
                e = heapq.heappop(queue)
                if last is not None and e[:2] > last:
                    queue.clear()
                elif e[2] < t.n_leaves:
                    leaves.append(e[2])
                else:
                    for c in t.children(e[2]):
                        if below := entry(c):
                            heapq.heappush(queue, below)
            if not leaves:
                break
            at_once *= 2
            self._scored(leaves)
            place = np.concatenate([np.arange(x * t.leaf_rows, min((x + 1) * t.leaf_rows, len(t.ids))) for x in leaves])
            score = np.concatenate([self.scores[x] for x in leaves])
            good = self.fits[place] & (score >= low) & (score <= high) & (t.rows[place] != self.row)
            if last is not None:
                good &= score >= -last[0]
            if good.any():
                place, score = place[good], score[good]
                if len(score) > 4 * k:  # those below the kth score can't be among the first k
                    enough = score >= np.partition(score, len(score) - k)[len(score) - k]
                    place, score = place[enough], score[enough]
                best = heapq.nsmallest(k, best + list(zip((-score).tolist(), t.ids[place].tolist(), place.tolist())))
                if last is not None:
                    best = [b for b in best if b[:2] <= last]
                if len(best) == k:
                    last = best[-1][:2]
        return [(-s, int(t.rows[p]), i) for s, i, p in best]


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _visitor(k: int, d: int, same: bool, leaf_rows: int):
    """Of a tile's rows and some anchors with windows: the first k rows in each window."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            tree = Tree(_matrix(rows["q"], d), _numbers(rows["id"]), _numbers(rows["label"]), _numbers(rows["row"]), leaf_rows)
            vectors, labels, numbers, windows = _matrix(anchors["q"], d), anchors["label"].to_pylist(), anchors["anchor"].to_pylist(), anchors["windows"].to_pylist()
            for first in range(0, len(numbers), 256):
                least, most = tree.bounds(vectors[first : first + 256])
                for i in range(first, min(first + 256, len(numbers))):
                    a = Anchor(tree, vectors[i], labels[i], numbers[i], same, least[i - first], most[i - first])
                    for w in windows[i]:
                        floor = None if w["score"] is None else (w["score"], w["id"])
                        found += [(numbers[i], w["slot"], *x) for x in a.search(w["low"], w["high"], k, floor)]
        columns = list(zip(*found)) if found else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "slot", "score", "row", "id"])

    return run


def first_k(found: DataFrame, k: int) -> DataFrame:
    """Of each anchor and slot the first k rows, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Rows (id, label, q) packed into tiles. labels are numbers from here on; row is a number that tells rows apart."""

    def __init__(self, rows: DataFrame, d: int, tile_rows: int = TILE_ROWS, leaf_rows: int = LEAF_ROWS) -> None:
        self.d, self.leaf_rows = d, leaf_rows
        at = lambda i: F.get("q", F.lit(i)) if d > i else F.lit(0)
        rest = [F.col("id"), F.xxhash64("q", "label"), F.col("q"), F.col("label")]
        rows = numbered(rows, [at(0), *rest], "place")
        n = rows.count()
        self.tiles = max(1, -(-n // tile_rows))
        slab = -(-self.tiles // max(1, round(self.tiles**0.5))) * tile_rows
        rows = numbered(rows.withColumn("slab", F.floor(F.col("place") / slab)).drop("place"), [F.col("slab"), at(1), *rest], "row")
        self.rows = materialize(rows.drop("slab").withColumn("tile", F.floor(F.col("row") / tile_rows).cast("int")), "tiles")

    def search(self, anchors: DataFrame, k: int, same: bool, block_rows: int = ANCHOR_BLOCK) -> DataFrame:
        """anchor, slot, score, row, id, rank: of each anchor (anchor, tile, label, q, windows) and window the first k rows."""
        run, kind = _visitor(k, self.d, same, self.leaf_rows), FOUND
        anchors = materialize(anchors, "anchors")
        own = materialize(self._visited(self.rows, anchors, ["tile"], run, kind), "own-tile")
        # The kth row of the own tile bounds what other tiles may add; floors has a row for each anchor and slot at most.
        last = own.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("score", "id"), F.struct(F.bitwise_not("score"), "id")).alias("floor")).where(F.col("n") >= k)
        last = last.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))
        floor = lambda w, field: F.try_element_at("floors", w["slot"])[field].alias(field)
        narrowed = F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), w["low"].alias("low"), w["high"].alias("high"), floor(w, "score"), floor(w, "id")))
        blocks = max(1, -(-anchors.count() // block_rows))
        others = (
            anchors.join(last, "anchor", "left").withColumn("windows", narrowed.cast(WINDOWS)).drop("floors")
            .withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
            .withColumn("home", F.col("tile")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(self.tiles - 1)))).where("tile <> home").drop("home")
        )
        rows = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return first_k(own.unionByName(self._visited(rows, others, ["tile", "block"], run, kind)), k)

    @staticmethod
    def _visited(rows: DataFrame, anchors: DataFrame, key: list[str], run, kind: str) -> DataFrame:
        return rows.groupBy(*key).cogroup(anchors.groupBy(*key)).applyInArrow(run, kind)


def takes_part(label: str, vector: str) -> Column:
    entries = F.col(vector).cast("array<double>")
    return F.col(label).isNotNull() & ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def quantised(vector: str, scale: int = 256) -> Column:
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale))


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "q", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, whole: int = 100, tile_rows: int = TILE_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: a long id, an integer label and a vector of longs, none of the latter two null; is_anchor: a condition on rows. For
    each of an anchor's first positives of its label: the first rows of other labels with
    low * positive_score <= whole * negative_score <= high * positive_score.
    """
    named = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchors"))
    d, shortest = named.agg(F.max(F.size("q")), F.min(F.size("q"))).first()
    d = d or 0
    if d and shortest < d:
        named = named.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("q"))))
    if not d:
        named = named.withColumn("q", F.array(F.lit(0).cast("long")))
        d = 1
    index = Index(named.withColumn("id", F.coalesce("id", F.lit(NO_ID))), d, tile_rows, leaf_rows)
    anchors = index.rows.where("anchors").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "tile", "label", "q")
    none = F.lit(None).cast("long")
    everything = F.array(F.struct(F.lit(1).alias("slot"), F.lit(-MOST).alias("low"), F.lit(MOST).alias("high"), none.alias("score"), none.alias("id")))
    found = materialize(index.search(anchors.drop("anchor_id").withColumn("windows", everything.cast(WINDOWS)), positives, True, block_rows), "positives")
    found = found.select("anchor", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    # The window of a positive: ceil(low * score / whole) to floor(high * score / whole); without a score in it, there's none.
    least, most = -F.floor(-F.col("positive_score").cast("decimal(38,0)") * low / whole), F.floor(F.col("positive_score").cast("decimal(38,0)") * high / whole)
    windows = found.select("anchor", F.struct("slot", least.cast("long").alias("low"), most.cast("long").alias("high"), none.alias("score"), none.alias("id")).alias("w")).where("w.low <= w.high")
    windows = windows.groupBy("anchor").agg(F.array_sort(F.collect_list("w")).cast(WINDOWS).alias("windows"))  # one for each positive
    hard = index.search(anchors.drop("anchor_id").join(windows, "anchor"), negatives, False, block_rows)
    hard = hard.select("anchor", "slot", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    out = hard.join(found, ["anchor", "slot"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    id_of = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select(id_of("anchor_id"), id_of("positive_id"), "rank", id_of("negative_id"), "positive_score", "negative_score")
