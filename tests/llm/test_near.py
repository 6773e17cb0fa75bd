"""Order MinHash classes and repeated passages against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import near_dedup, queries, shingles, substring_dedup

from .common import PROSE, SCHEMA, clashing, empty, odd, odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _labels(text):
    w = WORD.findall((text or "").lower())
    if not w:
        return []
    seen, out = Counter(), []
    for g in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _classes(docs):
    labels = [_labels(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = labels[i], labels[j]
            if not a or not b:
                linked = not a and not b
            elif len(set(a) & set(b)) * 1.8 < 0.8 * (len(a) + len(b)) - 1e-9:
                linked = False
            else:
                m = _lcs(a, b)
                linked = m / (len(a) + len(b) - m) >= 0.8 - 1e-12
            if linked:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(docs))]


def _compare(docs, out):
    groups = defaultdict(list)
    for (k, _), c in zip(docs, _classes(docs), strict=True):
        groups[c].append(k)
    want = {k: (min(v), len(v)) for v in groups.values() for k in v}
    got = {r.id: (r.class_id, r.class_size) for r in out}
    assert got == want
    assert Counter(r.class_id for r in out if r.kept) == Counter({min(v): 1 for v in groups.values()})


def _edited(base, n, seed):
    r = np.random.default_rng(seed)
    out = list(base)
    for _ in range(n):
        at = int(r.integers(len(out)))
        kind = r.integers(3)
        out[at : at + (kind != 1)] = [] if kind == 2 else [f"x{int(r.integers(10**6))}"]
    return " ".join(out)


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 8)  # so that buckets are split into several blocks
    docs, key = [], 0
    for family in range(6):
        base = words(120, family)
        for copy in range(14):  # edits of up to a tenth of the words: both sides of the threshold
            docs.append((key, _edited(base, copy % 7 * 2 if family < 5 else copy, family * 100 + copy)))
            key += 1
    shared = " ".join(words(60, 77))
    docs += [(key + i, shared + " " + " ".join(words(20 + 10 * (i % 5), 900 + i))) for i in range(25)]
    key += 25
    docs += [(key, ""), (key + 1, None), (key + 2, " \n"), (key + 3, "one two"), (key + 4, "One  TWO"), (key + 5, "two one"), (key + 6, PROSE), (key + 7, " ".join(reversed(PROSE.split())))]
    _compare(docs, near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_classes_of_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = queries.op2_near_dedup(spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    _compare(docs, out)


def test_near_odd_rows(spark):
    df = clashing(odd(spark))
    out = near_dedup.classes(df).collect()
    assert len(out) == len(odd_rows())
    sizes = Counter((r.id, r.class_size) for r in out)
    assert sizes[(6, 2)] == sizes[(7, 2)] == 1 and sizes[(2, 4)] == 2 and sizes[(3, 4)] == 1
    assert sum(r.kept for r in out) == len({r.class_id for r in out})
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in out)
    assert near_dedup.classes(empty(spark)).count() == 0 and near_dedup.deduplicate(empty(spark)).count() == 0


def test_shingle_hashes_are_those_of_words():
    texts = [" ".join(words(50, i)) for i in range(40)] + ["", "  ", "a", "a b c", "x y \x1f z", PROSE * 3]
    seen = {}
    for _, w in shingles.blocks(pa.array(texts)):
        for i, t in enumerate(texts):
            own = w.hashes[w.first[i] : w.first[i + 1]].tolist()
            assert len(own) == len(WORD.findall(t))
            for a, b in zip(WORD.findall(t), own, strict=True):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(words(4000, 8)) + " " + "y" * 3000 + " end"
    ((_, whole),) = shingles.blocks(pa.array([text]))
    monkeypatch.setattr(shingles, "BLOCK", 512)
    ((_, parts),) = shingles.blocks(pa.array([text]))
    assert (whole.hashes == parts.hashes).all()


def test_compact_windows_are_all_maximal_stretches():
    text = " ".join(words(160, 3)) + " " + " ".join(words(30, 3))
    ((_, w),) = shingles.blocks(pa.array([text]))
    s = shingles.shingles(w)
    _, order, left, centre, right = substring_dedup.compact_windows(s)
    t = substring_dedup.LEAST
    for f in range(substring_dedup.HASHES):
        y = [(int(v) & ~((1 << 20) - 1), i) for i, v in enumerate((s.hashes * substring_dedup.ORDERS[f]).tolist())]
        want = set()
        for c in range(len(y)):
            i, j = c, c
            while i > 0 and y[i - 1] > y[c]:
                i -= 1
            while j + 1 < len(y) and y[j + 1] > y[c]:
                j += 1
            if j - i + 1 >= t:
                want.add((i, c, j))
        mine = order == f
        assert set(zip(left[mine].tolist(), centre[mine].tolist(), right[mine].tolist())) == want


def _planted():
    docs = [(i, words(200, 50 + i)) for i in range(40)]
    exact, near = words(55, 1000), words(80, 1001)
    for i in (3, 7, 11, 30):
        docs[i] = (i, docs[i][1][: 20 * (i % 5)] + exact + docs[i][1][20 * (i % 5) :])
    for k, i in enumerate((5, 9, 21)):
        p = list(near)
        if k:
            p[40] = f"other{k}"
        docs[i] = (i, docs[i][1][:60] + p + docs[i][1][60:])
    docs[33] = (33, docs[33][1][:90] + exact[:40] + docs[33][1][90:])  # too short to count
    return [(i, " ".join(w)) for i, w in docs] + [(40, " ".join(docs[2][1])), (41, None), (42, ""), (43, " ".join(words(10, 5))), (44, " ".join(words(10, 5)))]


def test_passages_planted(spark):
    docs = _planted()
    out = substring_dedup.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    pairs = {(r.id, r.first_id) for r in out}
    # The two edited copies may also meet under a signature that the first one lacks.
    assert pairs - {(21, 9)} == {(7, 3), (11, 3), (30, 3), (9, 5), (21, 5), (40, 2)}
    text = {k: (t or "").lower().split() for k, t in docs}
    for r in out:
        a, b = text[r.id][r.start : r.end], text[r.first_id][r.first_start : r.first_end]
        assert len(a) >= 50 and r.similarity >= 0.8
        if r.similarity == 1 and (r.id, r.first_id) != (40, 2):
            assert a == b and len(a) == 55


def _spans(spark, docs):
    """Words of each text that are reported as repeated."""
    out = defaultdict(set)
    for r in substring_dedup.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        out[r.id].update(range(r.start, r.end))
    return out


def _repeats(docs):
    """Words of each text that lie in 50 words which an earlier text has too."""
    seen, out = {}, defaultdict(set)
    for k, t in sorted(docs):
        w = t.split()
        grams = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, g in enumerate(grams):
            if g in seen:
                out[k].update(range(i, i + 50))
        seen.update(dict.fromkeys(grams))
    return out


def test_periodic_repeats_match_brute_force(spark):
    docs = []
    for k, (period, length) in enumerate(((1, 120), (2, 120), (8, 160), (12, 600))):
        line = words(period, 300 + k)
        run = (line * length)[:length]
        docs += [(2 * k + i, " ".join(words(60 + 20 * i, 400 + 2 * k + i) + run + words(70, 500 + 2 * k + i))) for i in range(2)]
    got, want = _spans(spark, docs), _repeats(docs)
    assert set(got) == set(want) == {1, 3, 5, 7}
    for k in want:
        assert want[k] <= got[k] and len(got[k] - want[k]) <= 20


def _variant(base, seed, edits=2):
    """base (50 words) with so many words replaced, which keeps all its signatures."""
    r = np.random.default_rng(seed)

    def signed(w):
        ((_, b),) = shingles.blocks(pa.array([" ".join(w)]))
        return sorted(substring_dedup.signatures(shingles.shingles(b))[1].tolist())

    while True:
        out = list(base)
        for at in r.choice(np.arange(4, 46), edits, replace=False).tolist():
            out[at] = f"x{int(r.integers(10**6))}"
        kept = len({tuple(out[i : i + 5]) for i in range(46)} & {tuple(base[i : i + 5]) for i in range(46)})
        if kept == 46 - 5 * edits and signed(out) == signed(base):
            return out


def test_every_place_of_a_passage_is_found(spark):
    twice, hidden, third = words(55, 700), words(50, 701), words(50, 702)
    text = lambda seed, *parts: " ".join(sum(([*words(30, seed + i), *p] for i, p in enumerate(parts)), []) + words(30, seed + 9))
    docs = [(0, text(710, twice)), (1, text(720, twice, twice)), (2, text(730, hidden)), (3, text(740, _variant(hidden, 1), hidden))]
    docs += [(4, text(750, _variant(third, 2), third)), (5, text(760, third))]  # the edited copy comes first in the first text
    got, want = _spans(spark, docs), _repeats(docs)
    assert set(got) == set(want) == {1, 3, 5}
    assert len(want[1]) == 110 and all(want[k] <= got[k] and len(got[k] - want[k]) <= 10 for k in want)


def test_a_text_that_failed_once_is_compared_with_others(spark):
    one, two = words(60, 800), words(50, 801)
    text = lambda seed, *parts: " ".join(sum(([*words(30, seed + i), *p] for i, p in enumerate(parts)), []) + words(30, seed + 9))
    docs = [(0, text(810, one, _variant(two, 3))), (1, text(820, two)), (2, text(830, one, two)), (3, text(840, _variant(two, 4)))]
    got, want = _spans(spark, docs), _repeats(docs)
    assert set(got) == set(want) == {2} and len(want[2]) == 110 and want[2] <= got[2]


@pytest.mark.parametrize("n,common", [(54, 30), (54, 44), (54, 48), (60, 49), (80, 60)])
def test_exact_repeats_around_a_common_part(spark, n, common):
    """Pairs of texts that share a passage word for word, of which all pairs have the middle."""
    middle, docs = words(common, 4000 + n + common), []
    for k in range(40):
        edge = words(n - common, 5000 + k)
        half = (n - common) // 2
        docs += [(2 * k + i, " ".join(words(40, 6000 + 2 * k + i) + edge[:half] + middle + edge[half:] + words(40, 8000 + 2 * k + i))) for i in range(2)]
    got, want = _spans(spark, docs), _repeats(docs)
    assert sum(len(v) >= n for v in want.values()) == 40
    # Where the middle is a repeat by itself, it settles the places in it, and the edges beside it may go unreported.
    assert all(len(want[k] - got[k]) <= (0 if common < 50 else n - common) for k in want)


def test_hot_signatures_are_dealt_over_parts(spark, monkeypatch):
    from waymark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(near_dedup, "FEW_ROWS", 0)
    docs = _planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.id for r in substring_dedup.passages(df).collect()} == {7, 11, 30, 9, 21, 40}
    copies = [(i, " ".join(_edited_tail(i))) for i in range(30)]
    _compare(copies, near_dedup.classes(spark.createDataFrame(copies, "doc_id long, text string")).collect())


def _edited_tail(i):
    return words(120, 1) + words(1 + i % 3, 600 + i)


def test_near_passages_are_found(spark):
    """Recall and spans of passages with edits, against their definition: pairs of texts that share 50 words or more with a
    similarity of shingles of 0.8 or more."""
    docs, planted = [], {}
    for k in range(240):
        length, edits = ((54, 1), (70, 1), (100, 2), (200, 3))[k % 4]
        p = words(length, 5000 + k)
        q, r = list(p), np.random.default_rng(k)
        for at in r.choice(np.arange(5, length - 5), edits, replace=False).tolist():
            q[at] = f"z{int(r.integers(10**6))}"
        shared = len({tuple(p[i : i + 5]) for i in range(length - 4)} & {tuple(q[i : i + 5]) for i in range(length - 4)})
        assert shared / (2 * (length - 4) - shared) >= 0.8
        before = [words(int(n), 9000 + 2 * k + i) for i, n in enumerate(r.integers(0, 80, 2))]
        docs += [(2 * k, " ".join(before[0] + p + words(40, 20_000 + k))), (2 * k + 1, " ".join(before[1] + q + words(40, 30_000 + k)))]
        planted[2 * k + 1] = set(range(len(before[1]), len(before[1]) + length))
    got = _spans(spark, docs)
    assert set(got) <= set(planted)
    found = [k for k, v in planted.items() if len(v & got.get(k, set())) >= 0.9 * len(v)]
    short = [k for k in planted if (k - 1) // 2 % 4 == 0]
    assert len(found) >= 0.95 * len(planted) and len(set(short) & set(found)) >= 0.9 * len(short)
    assert all(len(got[k] - planted[k]) <= 12 for k in got)  # at most a fifth of a stretch may be foreign at its ends


def test_passages_of_documents(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    docs = {k: WORD.findall(t) for k, t in docs.items()}
    where = defaultdict(set)
    for k, w in docs.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    later = {k for s in where.values() if len(s) > 1 for k in s - {min(s)}}
    out = queries.op3_substring_dedup(spark, sf_dir).collect()
    assert later <= {r.doc_id for r in out}
    for r in out:
        a, b = docs[r.doc_id][r.start : r.end], docs[r.first_doc_id][r.first_start : r.first_end]
        x, y = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (a, b))
        assert len(a) >= 50 and len(x & y) / len(x | y) > 0.7


def test_passages_odd_rows(spark):
    df = clashing(odd(spark))
    out = substring_dedup.passages(df).collect()
    assert {(r.id, r.first_id) for r in out} == {(7, 6)}
    cut = substring_dedup.remove_passages(df)
    assert cut.columns == df.columns and cut.count() == len(odd_rows())
    assert [r.text for r in cut.where("doc_id = 7").collect()] == ["end"]
    assert substring_dedup.passages(empty(spark)).count() == 0 and substring_dedup.remove_passages(empty(spark)).count() == 0
