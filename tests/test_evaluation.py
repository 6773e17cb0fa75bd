"""Pairs of places close to each other, and results that are worked out once."""

from __future__ import annotations

import random

from waymark.operators import evaluation as E


def test_close_pairs_against_all_pairs():
    r = random.Random(4)
    for lat in (0.0, 34.0, -60.0):
        a, b = ([(lat + r.choice([0.0, 1e-4, r.uniform(0, 1e-3)]), 108.0 + r.uniform(0, 2e-3)) for _ in range(80)] for _ in range(2))
        want = [(i, j, d) for i, m in enumerate(a) for j, h in enumerate(b) if (d := E._metres(m, h)) <= 20.0]
        assert want and E.close_pairs(a, b, 20.0) == want


def test_thinning_works_its_scores_out_once(spark, tmp_path):
    def run(pdf):
        (tmp_path / f"{pdf.region.iloc[0]}-{random.SystemRandom().random()}").touch()
        return pdf.assign(precision=1.0)

    starts = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "region long, start long")
    scores = starts.groupBy("region").applyInPandas(run, "region long, start long, precision double")
    edges = spark.createDataFrame([(1, 0, 1, 50.0), (2, 0, 1, 50.0)], "region long, u long, v long, length double")
    assert E.thin_results(scores, edges, 120.0).count() == 3
    assert len(list(tmp_path.iterdir())) == 2
