"""Mixing, line dedup and exact dedup against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from waymark.llm import exact_dedup, line_dedup, mixing

from .common import SCHEMA, clashing, empty, odd, odd_rows, words


def test_exact_assignments(spark):
    rows = odd_rows()
    out = exact_dedup.assignments(clashing(odd(spark)), n_runs=16).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(out) == len(rows)
    kept = Counter()
    for r in out:
        text = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r.sha))
        ids = [i for i in groups[text] if i is not None]
        assert r.keep_id == (max(ids) if ids else None)
        assert r.group_size == len(groups[text])
        kept[text] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.assignments(empty(spark)).count() == 0


def test_exact_deduplicate(spark):
    df = clashing(odd(spark))
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len({r[1] or "" for r in odd_rows()})
    assert sum(r.doc_id == 2 for r in rows) == 1
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def test_exact_hot_group(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text")
    out = exact_dedup.assignments(df, n_runs=64)
    assert out.where("kept").count() == 2000 - 667 + 1
    assert out.where("group_size = 667 and keep_id = 1998").count() == 667


def _fill(sizes, weights, budget, epochs):
    clamped = set()
    while True:
        free = budget - sum(epochs * sizes[s] for s in clamped)
        w = sum(weights[s] for s in sizes if s not in clamped)
        target = {s: epochs * sizes[s] if s in clamped else weights[s] * free / w if w else 0.0 for s in sizes}
        over = {s for s in sizes if target[s] > epochs * sizes[s] and s not in clamped}
        if not over:
            return target
        clamped |= over


def test_mixing_targets_and_takes(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), None, f"s{i % 5 if i % 3 else 0}", None) for i in range(3000)]
    out = mixing.plan(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target = _fill(sizes, weights, sum(sizes.values()), 3)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 8
    again = {(r.id, r.taken) for r in mixing.plan(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert again == {(r.id, r.taken) for r in out}


def test_mixing_clamps(spark):
    sources = spark.createDataFrame([("a", 10, 100), ("b", 1000, 1), ("c", 1000, 2), (None, 0, 5)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    want = _fill({"a": 10, "b": 1000, "c": 1000, None: 0}, {"a": 100, "b": 1, "c": 2, None: 5}, 2010, 3)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mixing_odd_rows(spark):
    df = clashing(odd(spark))
    out = mixing.plan(df)
    assert out.count() == len(odd_rows())
    assert {r.source for r in out.where("size = 0").collect()} >= {"b", None}
    assert out.where("copies > 3 or copies < 0").count() == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    took = {(r.id, r.source): r.copies for r in out.collect()}
    counts = Counter((r.doc_id, r.source) for r in mixed.collect())
    rows = Counter((r[0], r[3]) for r in odd_rows())
    assert all(counts[k] == took[k] * rows[k] for k in rows)
    assert mixing.plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def _lines(docs):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    first, gone = {}, defaultdict(set)
    for i in order:
        lines = docs[i][1].split("\n") if docs[i][1] is not None else []
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if re.search(r"\S", "".join(w)):
                if w in first:
                    gone[i] |= {k, k + 1, k + 2}
                else:
                    first[w] = (i, k)
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t is not None else None for i, (_, t) in enumerate(docs)]


def test_lines(spark):
    pool = words(12, 4)
    import random

    r = random.Random(2)
    docs = [(i, "\n".join(r.choice(pool[: 3 + i % 9]) for _ in range(r.randint(0, 12)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "a\nb"), (504, "x\nx\nx\nx\nx"), (None, "x\nx\nx")]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {x.doc_id: x for x in out.collect()}
    for (k, t), want in zip(docs, _lines(docs), strict=True):
        assert got[k].text == want, k
        assert got[k].n_lines == (len(t.split("\n")) if t is not None else 0)
    assert got[504].n_removed == 4 and got[504].text == "x"


def test_many_lines_gone_cost_once(spark):
    import time

    long = "\n".join(f"line {i}" for i in range(40_000))
    half = "\n".join(f"line {i}" if i % 8 < 4 else f"own {i}" for i in range(40_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, half)], "doc_id long, text string")
    start = time.perf_counter()
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.perf_counter() - start < 15  # 22 s when each line was looked up among all that go
    assert out[1].text == long and out[2].text == "" and out[2].n_removed == 40_000
    assert out[3].text == "\n".join(f"own {i}" for i in range(40_000) if i % 8 >= 4) and out[3].n_removed == 20_000


def test_lines_odd_rows(spark):
    df = clashing(odd(spark))
    out = line_dedup.dedup_lines(df)
    assert out.count() == len(odd_rows()) and set(df.columns) <= set(out.columns)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
