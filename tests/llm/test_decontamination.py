"""Windows of test items in texts, against a plain search."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm.common import clashing, empty, odd
from waymark.llm import decontamination as dc

ITEMS = "item_id long, text string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(texts, items, window=10):
    out = []
    for t in texts:
        ws, hit, ids = words_of(t), set(), set()
        for i, item in items:
            iw = words_of(item)
            m = min(window, len(iw))
            for k in range(len(iw) - m + 1 if m else 0):
                for p in range(len(ws) - m + 1):
                    if ws[p : p + m] == iw[k : k + m]:
                        hit |= set(range(p, p + m))
                        ids |= {str(i)} if i is not None else set()
        out.append((len(ws), len(hit), sorted(ids)))
    return out


def answers(spark, texts, items, **how):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(dc.hits(docs, spark.createDataFrame(items, ITEMS), **how).collect())
    for r in rows:
        spans = [(s.start, s.end) for s in r.spans]
        assert all(s < e for s, e in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    return [(r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in rows]


@pytest.fixture(scope="module")
def cases():
    r = random.Random(3)
    vocabulary = ["a", "b", "The", "é", "日本", "x1", "ß", "tea", "A", "42"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 9, 10, 11, 30])))) for k in range(40) if k % 13]
    items = [(k, t if len(words_of(t)) > 2 or k < 4 else t + " rare words here") for k, t in items]
    items += [(7, "one more text of item seven"), (None, "nobody owns these four words"), (90, None), (91, " .;- "), (92, items[0][1])]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 9, 10, 200]))) for _ in range(60)]
    for _ in range(60):
        t = r.choice(items)[1] or ""
        texts.append(re.sub(" ", lambda _: r.choice([" ", "\n", ", ", "--", "\x00"]), f"{r.choice(vocabulary)} {t} end").upper())
    return texts + [None, "", "   ", "nobody owns", "these four words"], items


def test_windows_against_plain_search(spark, cases):
    texts, items = cases
    assert answers(spark, texts, items) == plain(texts, items)


def test_blocks_of_items_give_the_same(spark, cases):
    texts, items = cases
    assert answers(spark, texts, items, block_bytes=1500) == plain(texts, items)


def test_long_texts_and_chunks(spark, cases, monkeypatch):
    texts, items = cases
    filler = " ".join(f"w{k % 991}" for k in range(200_000))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    long_text = f"{item} {filler} {item}"
    assert answers(spark, [long_text, filler, item[:-3]], [(5, item)]) == [(200_024, 24, ["5"]), (200_000, 0, []), (11, 11, ["5"])]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    real = dc.Words.__init__

    def blunt(self, data, offsets):
        real(self, data, offsets)
        self.hash = self.hash % np.uint64(2)

    monkeypatch.setattr(dc.Words, "__init__", blunt)
    p = dc.Patterns([("1", "red green blue"), ("2", "black")], 2)
    text = dc.Words(np.frombuffer(b"red green black blue green blue", np.uint8), np.array([0]))
    start, end, doc, item = p.search(text)
    assert sorted(zip(start.tolist(), end.tolist())) == [(0, 2), (2, 3), (4, 6)] and item.tolist() == [0, 1] and doc.tolist() == [0, 0]


def test_odd_rows(spark):
    df = clashing(odd(spark))
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while seven"), (1, None)], ITEMS)
    out = dc.decontaminate(df, items)
    assert out.columns == df.columns and df.count() == 12 and out.count() == 8 and out.where("text like 'the quick%'").count() == 0
    rows = dc.hits(df, items).collect()
    assert len(rows) == 12 and sum(r["items"] == ["1"] for r in rows) == 4
    assert dc.hits(empty(spark), items).count() == 0
    none = dc.hits(df, spark.createDataFrame([], ITEMS)).collect()
    assert len(none) == 12 and all(r.spans == [] and r["items"] == [] for r in none)
