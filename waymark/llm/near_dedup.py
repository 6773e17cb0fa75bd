"""Near-duplicate classes by Order MinHash over five-word shingles, verified by banded alignment.

Sketch: shingles are labelled by their occurrence within the text; each of SKETCHES hash orders picks the TUPLE smallest
labelled shingles and keeps them in the order of the text, so a signature depends on content and order. Texts that share a
signature are candidates. Two texts are linked if an order-keeping alignment of their labelled shingles, within the band
that the threshold allows, matches L of n and m with L / (n + m - L) >= SIMILARITY. Classes are what links connect.

No bucket of candidates is expanded into all of its pairs: texts with the same words are one node; then each node is verified
against one leader of each of its buckets; what that connects is one component. Only buckets that still hold several
components are looked at again, in blocks of bounded size, and there only pairs of different components are compared and
only links that connect are returned. So no link between different texts is lost, and no bucket is capped.

Defined results: letter case and the amount of white space are ignored. A null text is like an empty one; all texts without
words form one class. A text of one to four words has one shingle and is only linked to texts of the same words. The class id
is the smallest identifier of the class (null only if all are null); the row with it stays, and of rows repeated with that
identifier exactly one (if they differ in other columns, the one whose row has the smallest hash). Other columns are never
looked at otherwise.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import FEW_ROWS, fresh, materialize, one_per_key, spread_join

SIMILARITY = 0.8
SKETCHES, TUPLE = 12, 3
BLOCK_NODES = 256
#: Shingles that are compared at a time.
CHUNK = 4096
ORDERS = np.random.default_rng(11).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(s: sh.Shingles) -> np.ndarray:
    """SKETCHES signatures for each text that has shingles, in order; texts without any get zeros."""
    n = np.diff(s.first)
    out = np.zeros((len(n), SKETCHES), np.uint64)
    if not len(s.hashes):
        return out
    x = sh.labelled(s)
    full = np.flatnonzero(n > 0)
    starts, counts = s.first[:-1][full], n[full]
    rank = np.repeat(np.arange(len(full)), counts)
    for f in range(SKETCHES):
        y = x * ORDERS[f]
        places = np.full((len(full), TUPLE), len(x))  # a text with fewer shingles keeps what it has
        for r in range(TUPLE):
            low = np.minimum.reduceat(y, starts)
            at = np.flatnonzero(y == low[rank])
            at = at[y[at] != TOP]
            places[rank[at], r] = at
            y[at] = TOP
        places.sort(axis=1)
        picked = np.append(x, np.uint64(0))[places]
        sig = np.full(len(full), f + 1, np.uint64)
        for r in range(TUPLE):
            sig = sh.mix(sig * np.uint64(0x9E3779B97F4A7C15) + picked[:, r])
        out[full, f] = sig
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two labelled shingle sequences if it is least or more, else 0."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return 0.0
    _, p, q = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = least / (1 + least) * (n + m)
    if len(p) < need - 1e-9:
        return 0.0
    # More than n + m - 2 L places off the diagonal, a match can not be part of an alignment that is good enough.
    band = n + m - 2 * need
    near = np.abs(p - q) <= band + 1e-9
    p, q = p[near], q[near]
    q = q[np.argsort(p)]
    if len(q) > 1 and (np.diff(q) <= 0).any():
        tails: list[int] = []
        for v in q.tolist():
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
        matched = len(tails)
    else:
        matched = len(q)
    similarity = matched / (n + m - matched)
    return similarity if similarity >= least - 1e-12 else 0.0


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (hash of the text as it is), node (16 bytes: the words), sigs."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, words in sh.blocks(b.column(2)):
                node, sigs = sh.digests(words), signatures(sh.shingles(words))
                n, blank = len(node), sigs[:, 0] == 0
                lists = [None if z else v for z, v in zip(blank, sigs.view(np.int64).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, n), b.column(1).slice(row, n), pa.array([x.tobytes() for x in node], pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "t", "node", "sigs"]
                )

    return rows.mapInArrow(run, f"id {kind}, t long, node binary, sigs array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node, text for the nodes of wanted (node, id): texts are found by identifier and known by their words."""
    rows = docs.select(F.col(id_col).alias("own"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.join(wanted.select("id").distinct().hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, words in sh.blocks(b.column(0)):
                node = sh.digests(words)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in node], pa.binary()), b.column(0).slice(row, len(node))], names=["node", "text"])

    found = rows.select("text").mapInArrow(run, "node binary, text string")
    return found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def _labels(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, words in sh.blocks(column):
        s = sh.shingles(words)
        x = sh.labelled(s)
        out += [x[i:j] for i, j in zip(s.first[:-1], s.first[1:], strict=True)]
    return out


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are linked."""
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    # Many nodes may have one leader.
    counted = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    both = spread_join(both, texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b", counted, pairs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ok = pa.array([aligned(x, y, least) > 0 for x, y in zip(_labels(b.column(2)), _labels(b.column(3)), strict=True)], pa.bool_())
                yield b.select([0, 1]).filter(ok)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it is connected with) for all nodes of the edges (a, b).

    Labels flow along edges and then jump to the label of the label, so paths shorten by half a round; the driver only
    counts changes. Each round ends in a table of the shared folder. A node or label with many others is dealt over parts.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    rows, degree = both.count(), both.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        seen = spread_join(both, labels.withColumnsRenamed({"node": "b", "label": "theirs"}), "b", degree, rows).groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        flown = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        flown = flown if rows <= FEW_ROWS else materialize(flown, "flown")
        jump = flown.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(spread_join(flown, jump, "label", rows=rows).select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _overlaps(x: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each two sequences share. Columns of the product stand for shingles that several have."""
    n, rows = len(x), np.repeat(np.arange(len(x)), [len(v) for v in x])
    values, column, count = np.unique(np.concatenate(x) if x else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    several = count[column] > 1
    rows, column = rows[several], place[column[several]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        i, j = np.searchsorted(column, (lo, lo + CHUNK))
        part = np.zeros((n, CHUNK), np.float32)
        part[rows[i:j], column[i:j] - lo] = 1
        out += part @ part.T
    return out


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame | None:
    """Links within buckets that still hold several components: all others against the largest, and among themselves."""
    known = materialize(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "known")
    parts = lambda n: F.ceil(n / BLOCK_NODES).cast("int")
    open_buckets = (
        known.groupBy("bucket", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("who"))
        .groupBy("bucket")
        .agg(F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n"), F.sum("who").alias("who"))
        .where("n_labels > 1")
        .groupBy("n", "who")  # buckets of the same nodes are one
        .agg(F.min(F.struct("bucket", "main")).alias("b"))
        .select("b.bucket", F.col("b.main.label").alias("main"), parts(F.col("b.main.n")).alias("main_parts"), parts(F.col("n") - F.col("b.main.n")).alias("other_parts"))
    )
    rest = materialize(known.join(open_buckets, "bucket"), "open-buckets")
    if rest.isEmpty():
        return None
    texts = _texts(docs, id_col, text_col, nodes.join(rest.select("node").distinct(), "node", "left_semi").select("node", "id"))
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("node", F.lit("part")), F.when(is_main, F.col("main_parts")).otherwise(F.col("other_parts"))).cast("int")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    placed = rest.select("bucket", "node", "label", is_main.alias("is_main"), own.alias("part"), "main_parts", "other_parts")
    to = F.when(F.col("is_main"), F.transform(upto("other_parts"), lambda o: cell(0, F.col("part"), o))).otherwise(
        F.concat(
            F.transform(upto("main_parts"), lambda m: cell(0, m, F.col("part"))),
            F.transform(upto("other_parts"), lambda o: cell(1, F.least(F.col("part"), o), F.greatest(F.col("part"), o))),
        )
    )
    cells = placed.select("bucket", "node", "label", "is_main", "part", F.explode(to).alias("c")).select("bucket", "c.kind", "c.i", "c.j", "is_main", "part", "node", "label").join(texts, "node")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, part, names = (table.column(c).to_pylist() for c in ("node", "part", "label"))
        kind, i, j = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
        x = _labels(table.column("text").combine_chunks())
        sizes = np.array([len(v) for v in x])
        group, side = np.unique(names, return_inverse=True)[1], np.array(table.column("is_main").to_pylist() if kind == 0 else part)
        meets = group[:, None] != group[None, :]
        if kind == 0 or i != j:
            meets &= side[:, None] != side[None, :]
        # The share of shingles in common bounds the similarity from above.
        meets &= _overlaps(x) * (1 + least) >= least * (sizes[:, None] + sizes[None, :]) - 1e-3
        parent = {}

        def root(v: bytes) -> bytes:
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        out = []
        for p, q in np.argwhere(np.triu(meets, 1)).tolist():
            r, s = root(names[p]), root(names[q])
            if r != s and aligned(x[p], x[q], least) > 0:
                parent[max(r, s)] = min(r, s)
                out.append((nodes[p], nodes[q]))
        return pa.table([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return cells.groupBy("bucket", "kind", "i", "j").applyInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, t (hash of the text), class_id, class_size, kept."""
    sketched = materialize(_sketched(docs, id_col, text_col), "sketches")
    nodes = materialize(sketched.groupBy("node").agg(F.min("id").alias("id"), F.first("sigs").alias("sigs")), "nodes")
    members = nodes.select("node", F.explode("sigs").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(members.join(buckets.select("bucket", "leader"), "bucket"), "shared-buckets")
    pairs = materialize(shared.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialize(_texts(docs, id_col, text_col, nodes.join(named, "node", "left_semi").select("node", "id")), "texts")
    links = materialize(_verified(pairs, texts, least), "links")
    labels = components(links)
    more = _rest(shared.select("bucket", "node"), labels, nodes, docs, id_col, text_col, least)
    if more is not None:
        labels = components(links.union(more))
    # Rows by class. Copies are counted before they meet, and the decision travels back by node first.
    own = sketched.groupBy("node", "id", "t").agg(F.count(F.lit(1)).alias("n"))
    own = materialize(own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "own-labels")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "node", "t")
    best = own.groupBy("label").agg(F.min(place).alias("best"), F.sum("n").alias("class_size"))
    out = spread_join(own, best, "label", rows=own.count()).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select("id", "t", F.col("best.id").alias("class_id"), "class_size", ((place == F.col("best")) & (F.col("copy") == 1)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class, with all its columns."""
    key = fresh(docs, "wm_t", "wm_id", "wm_null")
    named = lambda i, t: [t.alias(key[0]), F.coalesce(i.cast("string"), F.lit("")).alias(key[1]), i.isNull().alias(key[2])]
    kept = classes(docs, id_col, text_col, least).where("kept").select(*named(F.col("id"), F.col("t")))
    mine = docs.select("*", *named(F.col(id_col), F.xxhash64(text_col)))
    return one_per_key(mine.join(kept, key, "left_semi"), key, docs.columns)
