"""Whitened vectors against numpy."""

from __future__ import annotations

import math
import random

import numpy as np

from waymark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(vectors):
    """n, deviations, whitened (k columns), explained of each vector, with a plain eigendecomposition."""
    d = max(map(len, vectors))
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, (x - sums / n) @ axes / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def compare(rows, out, k):
    n, deviation, whitened, explained = expected([v for _, v in rows])
    by_id = {}
    for r in out:
        by_id.setdefault(r.id, {})[r.component] = r
    assert len(out) == k * len(rows) and {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-9
    signs = {}
    for (i, _), dev, w in zip(rows, deviation, whitened):
        assert sorted(by_id[i]) == list(range(1, k + 1))
        for c, r in by_id[i].items():
            assert r.deviation == dev and math.isclose(r.explained, explained[c - 1], rel_tol=1e-9)
            if abs(w[c - 1]) > 1e-6:
                assert math.isclose(abs(r.whitened), abs(w[c - 1]), rel_tol=1e-6)
                assert signs.setdefault(c, r.whitened * w[c - 1] > 0) == (r.whitened * w[c - 1] > 0)


def cloud(n, d, seed):
    r = random.Random(seed)
    return [(i, [np.float32(r.gauss(0, 1 + k)).item() for k in range(d)]) for i in range(n)]


def test_against_numpy(spark):
    rows = cloud(300, 20, 1)
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # copies weigh nothing
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    compare(rows, whitening.whiten(df).collect(), 16)


def test_stripes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 60)
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 2)
    rows = cloud(200, 6, 2)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    compare(rows, whitening.whiten(df, stripe_cells=500).collect(), 6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*cloud(30, 4, 3), (30, [1.0, 2.0]), (30, [1.0, 2.0]), (None, [0.5, 0.5, 0.5, 0.5]), (31, [])]
    bad = [(40, None), (41, [1.0, None, 2.0, 3.0]), (42, [nan, 1.0, 1.0, 1.0]), (43, [inf, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows + bad], SCHEMA + ", ID string, x string")
    out = whitening.whiten(df).collect()
    assert len(out) == 4 * len(rows) and {r.id for r in out} == {i for i, _ in rows}
    once = [r for r in rows if r[0] not in (30, None)] + [(30, [1.0, 2.0]), (None, [0.5] * 4)]
    unique = {(r.id, r.component): r for r in out}
    compare(once, list(unique.values()), 4)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []


def test_no_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    out = whitening.whiten(df).collect()
    assert len(out) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error is None for r in out)
    flat = spark.createDataFrame([(i, [float(i), 3.0], 0) for i in range(5)], SCHEMA)
    out = whitening.whiten(flat).collect()
    assert [r.whitened is None for r in sorted(out, key=lambda r: (r.id, r.component))] == [False, True] * 5 and all(r.identity_error < 1e-9 for r in out)
    huge = spark.createDataFrame([(i, [1e30 * (-1) ** i, float(i)], 0) for i in range(4)], SCHEMA)
    assert len(whitening.whiten(huge).collect()) == 8
