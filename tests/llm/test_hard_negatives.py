"""Hard negatives against a comparison of every pair."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, q array<long>"


def plain(rows, k=5, low=80, high=100):
    """(anchor, positive, rank, negative, positive score, negative score) for anchors with vec_id % 10 = 0."""
    d = max((len(q) for _, _, q in rows), default=0)
    full = [(i, c, [*q, *[0] * (d - len(q))]) for i, c, q in rows]
    out = []
    for a, (i, label, q) in enumerate(full):
        if i is None or i % 10:
            continue
        others = sorted((-max(min(sum(x * y for x, y in zip(q, p)), hn.MOST), -hn.MOST), hn.NO_ID if j is None else j, c) for b, (j, c, p) in enumerate(full) if b != a)
        for ps, pid, _ in [o for o in others if o[2] == label][:k]:
            fit = [o for o in others if o[2] != label and low * -ps <= 100 * -o[0] <= high * -ps]
            name = lambda x: None if x == hn.NO_ID else x
            out += [(i, name(pid), rank, name(nid), -ps, -ns) for rank, (ns, nid, _) in enumerate(fit[:k], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("Tile", F.lit("y"))
    return sorted((tuple(r) for r in hn.mine(df, F.col("vec_id") % 10 == 0, "vec_id", **how).collect()), key=str)


@pytest.mark.parametrize("tile_rows,leaf_rows,block_rows", [(8192, 64, 4096), (40, 3, 5)])
def test_against_all_pairs(spark, tile_rows, leaf_rows, block_rows):
    r = random.Random(tile_rows)
    centres = [[r.randint(-40, 60) for _ in range(6)] for _ in range(5)]
    rows = [(i, r.randint(0, 3), [c + r.randint(-15, 15) for c in r.choice(centres)]) for i in range(260)]
    rows += [(300 + i, i % 2, rows[3][2]) for i in range(60)]  # ties, and a group of copies
    assert mined(spark, rows, tile_rows=tile_rows, leaf_rows=leaf_rows, block_rows=block_rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, 1, [5, 5]), (1, 1, [6]), (2, 2, [5, 4]), (3, 2, [4, 5]), (None, 2, [5, 4]), (None, 1, [5, 5]), (10, 3, []), (20, 2, [-9, -9]), (10, 1, [7, 1]), (10, 1, [7, 1])]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows, tile_rows=2, leaf_rows=1) == plain(rows)
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1])]) == []
    big = 1 << 62
    rows = [(0, 1, [big, 3]), (10, 1, [big, -3]), (1, 2, [big, big]), (2, 2, [-big, 1]), (3, 2, [2, 1 << 40])]
    assert mined(spark, rows) == plain(rows)


def test_who_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [0.5, -0.001]), (2, None, [0.5]), (3, 1, None), (4, 1, [None]), (5, 1, [nan]), (6, 1, [inf]), (7, 1, [-inf]), (8, 1, [1e30])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").where(hn.takes_part("label", "embedding"))
    out = dict(df.select("vec_id", hn.quantised("embedding")).collect())
    assert out == {1: [128, -1], 8: [hn.MOST]}


def test_boxes_save_work():
    """Where vectors lie in clusters, a search scores few leaves; box bounds hold for every row."""
    r = np.random.default_rng(1)
    centres = r.integers(-200, 200, (40, 8))
    vectors = centres[np.arange(4000) % 40] + r.integers(-5, 5, (4000, 8))
    tree = hn.Tree(vectors, np.arange(4000), np.zeros(4000, np.int64), np.arange(4000), 25)
    least, most = tree.bounds(vectors[:50])
    scores = vectors[:50] @ tree.vectors.T
    leaf = np.arange(4000) // 25
    assert (scores <= most[:, leaf]).all() and (scores >= least[:, leaf]).all()
    visited = 0
    for i in range(50):
        a = hn.Anchor(tree, vectors[i], 0, i, True, least[i], most[i])
        got = a.search(-hn.MOST, hn.MOST, 5, None)
        order = np.lexsort((tree.ids, -scores[i]))
        assert [x[2] for x in got] == [int(tree.ids[p]) for p in order if tree.rows[p] != i][:5]
        visited += len(a.scores)
    assert visited / 50 < 0.25 * tree.n_leaves
