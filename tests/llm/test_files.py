"""Lossless WebP, media columns, WARC archives, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from waymark.llm import media, queries, warc, webp_lossless

from .common import SCHEMA, clashing, empty, odd, odd_rows


@pytest.mark.parametrize("colours", [1, 2, 4, 15, 200, 256])
@pytest.mark.parametrize("size", [(1, 1), (3, 64), (7, 5), (40, 64)])
def test_webp_round_trips(size, colours):
    rgb = np.random.default_rng(colours).integers(0, colours, (*size, 3)).astype(np.uint8)
    assert (webp_lossless.decode(webp_lossless.encode(rgb))[..., :3] == rgb).all()
    ways = [{}, {"subtract_green": True}, {"cross": (5, -7, 33)}, {"cache_bits": 0}, {"cache_bits": 11}]
    for kw in ways + [{"modes": m, "cross": (1, 2, -3), "subtract_green": m % 2 == 0} for m in range(14)]:
        assert (webp_lossless.decode(webp_lossless.encode_thorough(rgb, **kw))[..., :3] == rgb).all(), kw


def test_webp_mixed_modes():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (17, 23, 3)).astype(np.uint8)
    modes = rng.integers(0, 14, (5, 6))
    assert (webp_lossless.decode(webp_lossless.encode_thorough(rgb, modes=modes))[..., :3] == rgb).all()


def test_webp_code_lengths_are_complete():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = rng.integers(0, 10 ** int(rng.integers(1, 7)), int(rng.integers(2, 300))) * rng.integers(0, 2, 1)[0] + rng.integers(0, 3)
        n = webp_lossless.code_lengths(counts)
        used = n[n > 0]
        assert (n > 0).sum() == (counts > 0).sum()
        assert len(used) <= 1 or (2.0**-used).sum() == 1 and used.max() <= webp_lossless.LIMIT


def test_webp_rejects_other_bytes():
    with pytest.raises(ValueError):
        webp_lossless.decode(b"RIFF....WEBPVP8 ....")


def test_media_of_odd_rows(spark):
    df = clashing(odd(spark))
    stored = media.stored(df)
    out = Counter((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.measured(stored).collect())
    want = Counter()
    for k, t, *_ in odd_rows():
        b = (t or "").encode()
        p = b + b" " * (192 if not b else -len(b) % 192)
        want[k, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert out == want
    pixels = media.pixel_arrays(stored).where("id = 1").first()
    assert bytes(pixels.pixels)[:3] == b"the" and pixels.width == 64 and len(pixels.pixels) == 4 * pixels.width * pixels.height
    assert media.measured(media.stored(empty(spark))).count() == 0


def test_webp_of_another_encoder():
    """The published one-pixel sample by which browsers are probed for lossless WebP."""
    import base64

    image = webp_lossless.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert image.shape == (1, 1, 4)


def test_media_files_use_every_tool(monkeypatch):
    """What the decoder undoes, file by file: a palette, or prediction, cross-colour, a cache and back-references."""
    used = Counter()

    def spied(name):
        real = getattr(webp_lossless, name)

        def call(*args):
            used[name] += 1
            if name == "_summed":
                used["mode", int(args[0][-1, -1])] += 1
            return real(*args)

        monkeypatch.setattr(webp_lossless, name, call)

    for name in ("_summed", "_cross", "_tokens"):
        spied(name)
    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)]
    for i in range(400):
        text = " ".join(words[k] for k in rng.integers(0, 300, 20 + 5 * i))
        payload = media.padded((text + "\n" + text[: i % 7 * 40]).encode())
        used.clear() if i == 0 else None
        stored = media.encode(payload)
        assert stored == media.encode(payload)
        before = used["_cross"]
        assert webp_lossless.decode(stored)[..., :3].tobytes()[: len(payload)] == payload
        assert used["_cross"] == before + 1  # the decoder's own
    assert used["_summed"] == 400 and used["_tokens"] >= 400
    assert all(used["mode", m] > 5 for m in range(14))
    for payload in (b" " * 192 * 50, b"ab" * 96 * 40, bytes(range(15)) * 64 * 9):
        assert webp_lossless.decode(media.encode(payload))[..., :3].tobytes()[: len(payload)] == payload
    payload = media.padded(" ".join(words[k] for k in rng.integers(0, 300, 60_000)).encode())  # beyond the shared codes
    assert webp_lossless.decode(media.encode(payload))[..., :3].tobytes()[: len(payload)] == payload


def test_files_are_read_together():
    """Many files at once give each file's own pixels: palettes, one colour, codes of their own, all modes and cache sizes."""
    rng = np.random.default_rng(11)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)]
    payloads = [media.padded((" ".join(words[k] for k in rng.integers(0, 300, 5 + 9 * i)) + "\n" + words[0] * (i % 5) * 9).encode()) for i in range(150)]
    payloads += [b" " * 192, b"ab" * 96 * 40, bytes(range(15)) * 64 * 9, bytes(192), rng.integers(0, 256, 192 * 99).astype(np.uint8).tobytes()]
    files = [media.encode(p) for p in payloads]
    rgb = rng.integers(0, 256, (17, 23, 3)).astype(np.uint8)
    files += [webp_lossless.encode_thorough(rgb // 64, modes=rng.integers(0, 14, (5, 6)), cache_bits=c) for c in (0, 1, 8, 9, 11)]
    for n in (len(files), 20):
        for file, image in zip(files[-n:], webp_lossless.decode_many(files[-n:]), strict=True):
            assert (image == webp_lossless.decode(file)).all()
    for payload, image in zip(payloads, webp_lossless.decode_many(files), strict=False):
        assert image[..., :3].tobytes()[: len(payload)] == payload
    assert webp_lossless.decode_many([]) == []
    for cut in (files[100][: len(files[100]) // 2], files[100][:-60]):
        for some in ([*files, cut], [cut, *files], [cut]):
            with pytest.raises(ValueError):
                webp_lossless.decode_many(some)


def test_media_factors_are_the_cheapest():
    """Green that was subtracted is found again by cross-colour factors, so a predicted payload is not longer than it was."""
    rng = np.random.default_rng(12)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)).encode()
    image = media.to_image(media.padded(text))
    for mode in range(1, 5):
        sizes = [len(webp_lossless.encode_thorough(image, modes=mode, cross=cross, subtract_green=True, block_bits=4)) for cross in ((0, -3, 1), media.CROSS[True])]
        assert sizes[1] < 0.95 * sizes[0]


def _predicted_by_hand(mode, left, top, corner, right):
    """One pixel's prediction, colour by colour, as the format's text has it."""
    avg = lambda a, b: (a + b) // 2
    if mode == 11:
        guess = [x + y - z for x, y, z in zip(left, top, corner)]
        return left if sum(abs(g - x) for g, x in zip(guess, left)) < sum(abs(g - y) for g, y in zip(guess, top)) else top
    out = []
    for x, t, c, r in zip(left, top, corner, right):
        half = avg(x, t)
        out.append({1: x, 2: t, 3: r, 4: c, 5: avg(avg(x, r), t), 6: avg(x, c), 7: avg(x, t), 8: avg(c, t), 9: avg(t, r), 10: avg(avg(x, c), avg(t, r)), 12: min(255, max(0, x + t - c)), 13: min(255, max(0, half + int((half - c) / 2)))}[mode])
    return out


@pytest.mark.parametrize("mode", range(1, 14))
def test_webp_predictions_by_hand(mode):
    px = np.random.default_rng(mode).integers(0, 256, (6, 9, 4)).astype(np.uint8)
    found = webp_lossless._differences(np.full((6, 9), mode, np.uint8), px)
    p = px.astype(int).tolist()
    for y in range(1, 6):
        for x in range(1, 9):
            right = p[y - 1][x + 1] if x < 8 else p[y][0]
            guess = _predicted_by_hand(mode, p[y][x - 1], p[y - 1][x], p[y - 1][x - 1], right)
            assert [(v - g) % 256 for v, g in zip(p[y][x], guess)] == found[y, x].tolist()
    assert (webp_lossless._summed(np.full((6, 9), mode, np.uint8), found) == px).all()


def test_very_long_payloads_widen_the_image():
    payload = bytes(range(192)) * 16385
    image = media.to_image(payload)
    assert image.shape[1] == 128 and image.tobytes()[: len(payload)] == payload


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    big, small = "é" * 200, "tiny"
    rows = [(5, "http://a/é b", big), (3, None, big), (9, "u", big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "x\r\n\r\n" * 50), (8, "u", "y" * 3_000_000), (8, "u", "y" * 3_000_000)]
    out = warc.read_records(warc.archive(_pages(spark, rows))).collect()
    got = Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = Counter()
    for k, _, h in rows:
        b = (h or "").encode()
        first = 3 if h == big else 8 if h and len(h) > 10**6 else k
        revisit = len(b) >= 100 and first != k
        want[str(k) if k is not None else None, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", str(first) if revisit else None] += 1
    assert got == want
    assert warc.read_records(warc.archive(_pages(spark, []))).count() == 0


def test_warc_members_and_sidecar(spark):
    done = warc.archive(_pages(spark, [(i, "u", f"page {i} " * 40) for i in range(20)]).coalesce(1)).collect()
    assert sum(r.n_records for r in done) == 20
    for r in done:
        data, index = open(r.archive, "rb").read(), [json.loads(x) for x in open(r.sidecar)]
        assert sum(e["length"] for e in index) == len(data)
        for e in index:
            member = gzip.decompress(data[e["offset"] : e["offset"] + e["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")


def test_warc_inflates_members_and_whole_files():
    import io

    parts = [warc.record(str(i), "u", b"p" * i, "d", i, None, False) for i in range(5)]
    for data in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        assert [len(b) for _, b in warc.records(warc.inflated(io.BytesIO(data)))] == [len(p) - p.index(b"\r\n\r\n") - 8 for p in parts]


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd_docs = docs.unionByName(odd(spark))
    sizes = [odd_docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == docs.columns, name
        odd_docs = spark.createDataFrame(out.collect(), SCHEMA)
        sizes.append(odd_docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, odd_docs, sf_dir)
    want = Counter()
    for r in odd_docs.collect():
        want[r.doc_id] += len(r.text.split())
    got = Counter()
    for r in packed.collect():
        got[r.doc_id] += r.n_words
    assert set(got) == set(want)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), sf_dir).count() == 0, name


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names} and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)
