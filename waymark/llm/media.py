"""Media columns: payloads stored as lossless WebP images, read back as pixel arrays, with features of the pixels.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the red, green and blue samples of an image 64
pixels wide (wider, by powers of two, where 64 would make it higher than the format allows; rows are then filled up with
zeros, which the stored payload length cuts off again). The media table is written to the shared folder and read back, so
that features come from stored bytes. Every payload of whatever size is stored with all tools: few colours with a palette, all
others with one of the fourteen predictors, cross-colour (of several factors those that take the fewest bits), colour cache and
back-references, every other with subtract green.

Defined results: a null text counts as empty and so is 192 spaces. Equal texts give equal values. A payload beyond the
format's largest image (805 MB) raises. Bytes that are not a lossless WebP file raise. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp_lossless
from .common import materialize

UNIT, WIDTH = 192, 64
#: What files are stored with besides a predictor mode: subtract green, bits of the colour cache.
SETTINGS = ((False, 4), (True, 5), (False, 6), (True, 7))
#: Cross-colour factors that are tried on each payload without and with green subtracted; 32 is once the other colour.
CROSS = {False: ((3, -5, 2), (0, 0, 1)), True: ((0, -3, 1), (0, -32, -32))}


def encode(payload: bytes) -> bytes:
    """A WebP file of the payload. The choice of tools depends on the payload alone, so equal texts have equal files."""
    image, mark = to_image(payload), zlib.crc32(payload)
    found = webp_lossless.palette(image)
    if found is not None:
        return webp_lossless.encode_palette(image, found)
    subtract_green, cache_bits = SETTINGS[mark // 14 % len(SETTINGS)]
    return webp_lossless.encode_thorough(image, modes=mark % 14, cross=CROSS[subtract_green], subtract_green=subtract_green, cache_bits=cache_bits, block_bits=4)


def to_image(payload: bytes) -> np.ndarray:
    width = WIDTH
    while len(payload) > 3 * width * webp_lossless.MAX_SIDE:
        width *= 2
    if width > webp_lossless.MAX_SIDE:
        raise ValueError("payload too long for one image")
    short = -len(payload) % (3 * width)
    return np.frombuffer(payload + bytes(short), np.uint8).reshape(-1, width, 3)


def padded(data: bytes) -> bytes:
    return data + b" " * (UNIT if not data else -len(data) % UNIT)


def features(pixels: np.ndarray) -> str:
    """Size, mean of each colour, and how the brightness is spread over four quarters of its range."""
    rgb = pixels[..., :3].reshape(-1, 3)
    grey = rgb.sum(1, dtype=np.int64)
    spread = np.bincount(np.minimum(grey * 4 // 766, 3), minlength=4)
    mean = rgb.sum(0, dtype=np.int64) * 1000 // len(rgb)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{','.join(map(str, mean.tolist()))}:{','.join(map(str, spread.tolist()))}"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, payload_bytes, media (a WebP file) per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, size, media = [], [], []
                for t in part.column(1):
                    data = t.as_buffer().to_pybytes()
                    payload = padded(data)
                    n.append(len(data))
                    size.append(len(payload))
                    media.append(encode(payload))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "payload_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, media binary")


def pixel_arrays(media: DataFrame, media_col: str = "media") -> DataFrame:
    """width, height and pixels (rows of red, green, blue, alpha bytes) in place of media_col; other columns stay."""

    @F.pandas_udf("width int, height int, pixels binary")
    def read(files):
        import pandas as pd

        images = [webp_lossless.decode(x) if x is not None else None for x in files]
        return pd.DataFrame([(None, None, None) if i is None else (i.shape[1], i.shape[0], i.tobytes()) for i in images], columns=["width", "height", "pixels"])

    return media.select(*[c for c in media.columns if c != media_col], read(F.col(media_col)).alias("_image")).select("*", "_image.*").drop("_image")


#: Files and their bytes (with one file at least) that are read together.
FILES, FILE_BYTES = 8192, 1 << 25


def _read(sizes: pa.Array, media: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Payload size, file and pixels of each row."""
    ends = np.cumsum(sizes.to_numpy())
    at = 0
    while at < len(media):
        upto = min(at + FILES, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FILE_BYTES))))
        files = [m.as_buffer().to_pybytes() for m in media[at:upto]]
        yield from zip(sizes[at:upto].to_pylist(), files, webp_lossless.decode_many(files), strict=True)
        at = upto


def measured(media: DataFrame) -> DataFrame:
    """Digests and features of the stored bytes and of the payload that they decode to."""
    kind = media.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, crc, size, media_sha, feature = [], [], [], [], []
            for n, stored, image in _read(b.column(2), b.column(3)):
                payload = image[..., :3].tobytes()[:n]
                sha.append(hashlib.sha256(payload).hexdigest())
                crc.append(zlib.crc32(payload[-16:]))
                size.append(len(stored))
                media_sha.append(hashlib.sha256(stored).hexdigest())
                feature.append(features(image))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(media_sha, pa.string()), pa.array(feature, pa.string())],
                names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.select("id", "n_bytes", "payload_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table, written to the shared folder and read back."""
    return materialize(encoded(docs, id_col, text_col), "media", "zstd")  # the heads of small files recur
