"""Token counts, language identification and packing."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from waymark.llm import language_id, packing, queries, token_counts

from .common import SCHEMA, clashing, empty, odd, odd_rows, words

SCRAPS = ["a", "the", "  ", "\n", "\x1c", "\x85", "é", "日本", "<|endoftext|>", "<|endof", "text|>", "'re", "'", "١", "²", "_", "́", "😀", "\x00", "\t", "ing", " 12", "​", "\r\n", "|", "###", "zzzzzz"]


def _library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def test_tokens_match_the_library():
    lib, own, r = _library(), token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY)), random.Random(1)
    texts = ["".join(r.choice(SCRAPS) for _ in range(r.randint(0, 12))) for _ in range(3000)] + words(2000, 3)
    for t in texts:
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False)), repr(t)


def test_every_prefix_and_budget():
    lib, own, r = _library(), token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY)), random.Random(7)
    n = lambda t: len(lib.encode(t, add_special_tokens=False))
    for _ in range(400):
        t = "".join(r.choice(SCRAPS) for _ in range(r.randint(0, 10)))
        table = own.table(t)
        assert all(own.tokens_before(t, *table, j) == n(t[:j]) for j in range(len(t) + 1)), repr(t)
        for budget in (0, 1, 3, 100):
            assert n(t[: own.truncate(t, *table, budget)]) <= budget
    counts = own.prefix_counts(b" international")
    assert counts[0] == 0 and counts[-1] == n(" international") and len(counts) == 15


def test_token_frames(spark):
    lib = _library()
    out = token_counts.token_counts(clashing(odd(spark))).collect()
    assert Counter((r.id, r.n_bytes, r.n_tokens) for r in out) == Counter((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False))) for r in odd_rows())
    assert token_counts.token_counts(empty(spark)).count() == 0
    cut = token_counts.truncated(odd(spark), 5).collect()
    assert all(len(lib.encode(r.text, add_special_tokens=False)) <= 5 for r in cut)
    assert token_counts.prefix_tables(odd(spark)).count() == len(odd_rows())


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op10_language_id(spark, sf).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_odd_rows(spark):
    df = clashing(odd(spark))
    model = language_id.fit(df)
    out = {(r.id, r.lang_pred) for r in language_id.identify(df, model).collect()}
    assert (3, "und") in out and (4, "und") in out and (5, "und") in out and (8, "und") in out and (None, "und") in out
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (3, 4, 5, 8)").count() == 0 and kept.where("doc_id = 1").count() == 1
    none = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.identify(odd(spark), none).collect()} == {"und"}
    assert language_id.identify(empty(spark), none).count() == 0


def _check_bins(rows, pieces, capacity, per_source):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.id].append(p)
        bins[p.bin_id].append(p)
    want = Counter()
    for k, n, *_ in rows:
        want[k] += n
    assert {k: sum(p.n_words for p in v) for k, v in by_doc.items()} == dict(want)
    info = {k: (s, c) for k, _, s, c in rows}
    for v in bins.values():
        assert sum(p.n_words for p in v) <= capacity
        v.sort(key=lambda p: (p.bin_offset, p.n_words))
        for a, b in zip(v, v[1:]):
            assert a.bin_offset + a.n_words <= b.bin_offset or not a.n_words
        if len(v) > 1:
            clusters = Counter(info[p.id][1] for p in v)
            assert max(clusters.values()) == 1
            assert max(Counter(info[p.id][0] for p in v).values()) <= per_source
    return len(bins)


def test_packing(spark):
    r = random.Random(5)
    docs = [(i, " ".join(["w%d" % (i % 90)] * r.choice([1, 3, 50, 99, 100, 101, 230])), None, f"s{i % 3}" if i % 2 else "hot", None) for i in range(600)]
    out = packing.pack(spark.createDataFrame(docs, SCHEMA), capacity=100, per_source=4).collect()
    rows = [(k, len(t.split()), s, t) for k, t, _, s, _ in docs]
    n = _check_bins(rows, out, 100, 4)
    assert n <= 1.35 * sum(r[1] for r in rows) / 100 + 20


def test_pack_block_is_tightest():
    bins, offsets = packing.pack_block([60, 50, 40, 40, 10], ["a"] * 5, [1, 2, 1, 3, 4], 100, 8)
    # The 40 of cluster 1 fits tightest with the 60 of cluster 1, but conflicts, so it joins the 50.
    assert bins == [0, 1, 1, 0, 1] and offsets == [0, 0, 50, 60, 90]


def _best_fit(sizes, sources, clusters, capacity, per_source):
    """Every bin is tried; the fullest one that is compatible takes the item, the lowest number of equal ones."""
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + size <= capacity and all(x[2] != cluster for x in b) and sum(x[1] == source for x in b) < per_source]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        out.append((k, sum(x[0] for x in bins[k])))
        bins[k].append((size, source, cluster))
    return [k for k, _ in out], [o for _, o in out]


def test_pack_block_matches_brute_force():
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(0, 60)
        items = sorted(((r.randint(0, 100), r.choice("abc"), r.randint(0, 12)) for _ in range(n)), key=lambda x: -x[0])
        args = [[x[k] for x in items] for k in range(3)]
        per = r.randint(1, 4)
        assert packing.pack_block(*args, 100, per) == _best_fit(*args, 100, per)


def test_blocks_fill_their_bins(spark, monkeypatch):
    r = random.Random(9)
    docs = [(i, " ".join(["w%d" % i] * r.randint(1, 150)), None, f"s{i % 5}", None) for i in range(800)]
    df = spark.createDataFrame(docs, SCHEMA)
    least = sum(len(t.split()) for _, t, *_ in docs) / 200
    counts = []
    for words_ in (2_000_000, 15_000):
        monkeypatch.setattr(packing, "BLOCK_WORDS", words_)
        counts.append(packing.pack(df, capacity=200).select("bin_id").distinct().count())
    assert counts[0] <= 1.06 * least and counts[1] <= 1.1 * least


def test_packing_odd_rows(spark):
    out = packing.pack(clashing(odd(spark))).collect()
    sizes = Counter()
    for r in odd_rows():
        sizes[r[0]] += len((r[1] or "").split())
    got = Counter()
    for p in out:
        got[p.id] += p.n_words
    assert got == sizes
    assert sum(p.id == 2 for p in out) == 2 and len({p.bin_id for p in out if p.id == 2}) == 2
    assert packing.pack(empty(spark)).count() == 0
