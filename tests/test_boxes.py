"""Boxes that meet, counted without making pairs."""

from __future__ import annotations

import random

import numpy as np

from waymark.operators import spatial


def test_counts_against_all_pairs(spark, monkeypatch):
    r = random.Random(2)
    place = lambda wide: (y := r.uniform(34.0, 34.01), x := r.uniform(108.0, 108.01), y + r.uniform(0, wide), x + r.uniform(0, wide))
    asked = [(k, *place(0.004)) for k in range(1500)] + [(5000, 10.0, 10.0, 11.0, 11.0)]
    boxes = [(r.randrange(40) if k % 3 else 7, *place(0.2 if k % 50 == 0 else 0.003)) for k in range(9000)]
    a = spark.createDataFrame(asked, "asked long, b0 double, b1 double, b2 double, b3 double")
    b = spark.createDataFrame(boxes, "owner long, y0 double, x0 double, y1 double, x1 double")
    got = {x.asked: (x.n, x.n_owners) for x in spatial.box_counts(a, b, slice_rows=4000).collect()}
    p, q = np.array([x[1:] for x in boxes]), np.array([x[0] for x in boxes])
    want = {}
    for k, b0, b1, b2, b3 in asked:
        meets = (b0 <= p[:, 2]) & (p[:, 0] <= b2) & (b1 <= p[:, 3]) & (p[:, 1] <= b3)
        if meets.any():
            want[k] = (int(meets.sum()), len(set(q[meets].tolist())))
    assert got == want and len(got) > 1400


def test_rows_of_a_dense_place(spark):
    """Of 2000 boxes and 20 000 at the same place, 40 million pairs, a join makes no more rows than boxes and blocks."""
    k = spark.range(20_000).withColumnRenamed("id", "owner").selectExpr("owner", "34.001 + owner * 1e-9 as y0", "108.001D as x0", "34.002D as y1", "108.002D as x1")
    a = spark.range(2000).selectExpr("id as asked", "34.0005 + id * 1e-9 as b0", "108.0005D as b1", "34.0015D as b2", "108.0015D as b3")
    rows, join = [], spatial.box_join
    try:
        spatial.box_join = lambda *x, **y: (rows.append(join(*x, **y)), rows[-1])[1]
        out = spatial.box_counts(a, k).collect()
    finally:
        spatial.box_join = join
    assert len(out) == 2000 and all(x.n == x.n_owners == 20_000 for x in out)
    assert rows[0].count() <= 3 * 20_000
