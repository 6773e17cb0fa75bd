"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document longer than a bin is cut into full bins and a rest. Rests and short documents are dealt by a hash of their
identifier into blocks of about BLOCK_WORDS words; each block is packed by itself, largest first. Open bins are kept in the
order of their residual; each carries a bitmap of its sources and one of its duplicate clusters. The search starts at the
first bin whose residual is large enough and goes on to its successors until a compatible one is found: the tightest one.
A bin takes no two members of a duplicate cluster, and at most per_source documents of a source (that many bits each).

Defined results: a null or blank text has no words and takes no room, but still gets a bin; null sources are one source;
repeated rows are members of one cluster. Pieces carry start and length in words, so whole texts are covered. Only sizes,
hashes and identifiers are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, n_words

CAPACITY = 2048
PER_SOURCE = 8
BLOCK_WORDS = 2_000_000
#: Documents of a block beyond which words alone would let it grow (very short texts).
BLOCK_ROWS = 8_000


def pack_block(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; items are taken in the order given."""
    source_bits: dict = {}
    cluster_bits: dict = {}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), in that order
    has_source: list[int] = []
    has_cluster: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = source_bits.setdefault(source, len(source_bits)) * per_source
        lane = ((1 << per_source) - 1) << s
        c = 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (has_cluster[open_bins[at][1]] & c or has_source[open_bins[at][1]] & lane == lane):
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(has_source)
            has_source.append(0)
            has_cluster.append(0)
        bins.append(b)
        offsets.append(capacity - residual)
        taken = has_source[b] & lane
        has_source[b] |= (taken + (1 << s)) & lane | taken  # the lane's lowest free bit
        has_cluster[b] |= c
        insort(open_bins, (residual - size, b))
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """One row per piece: id, piece, start, n_words, bin_id, bin_offset.

    cluster: the duplicate cluster of a row; by default rows of equal text are one.
    """
    cluster = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if cluster is None else cluster
    items = docs.select(F.col(id_col).alias("id"), F.xxhash64(source_col).alias("source"), cluster.alias("cluster"), n_words(text_col).alias("words"))
    # Repeated rows are counted, then numbered: each gets pieces and bins of its own.
    items = materialize(items.groupBy("id", "source", "cluster", "words").agg(F.count(F.lit(1)).alias("n")), "pack-items")
    total, rows = items.agg(F.sum(F.col("words") * F.col("n")), F.sum("n")).first()
    blocks = max(1, -(-int(total or 0) // BLOCK_WORDS), -(-int(rows or 0) // BLOCK_ROWS))
    items = items.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    n_full = F.floor(F.col("words") / capacity).cast("int")
    full = items.where(n_full > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), n_full - 1)))
    rests = items.where((F.col("words") == 0) | (F.col("words") % capacity > 0)).select(
        F.pmod(F.xxhash64("id", "cluster", "copy"), F.lit(blocks)).cast("int").alias("block"),
        "id",
        n_full.alias("piece"),
        (n_full.cast("long") * capacity).alias("start"),
        (F.col("words") % capacity).alias("n_words"),
        "source",
        "cluster",
        "copy",
    )
    kind = to_arrow_type(items.schema["id"].dataType)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("cluster", "ascending"), ("id", "ascending"), ("source", "ascending"), ("copy", "ascending")])
        block = table.column("block")[0].as_py()
        bins, offsets = pack_block(*(table.column(c).to_pylist() for c in ("n_words", "source", "cluster")), capacity, per_source)
        out = [table.column("id").cast(kind), table.column("piece"), table.column("start"), table.column("n_words"), pa.array([f"{block}-{b}" for b in bins], pa.string()), pa.array(offsets, pa.int64())]
        return pa.table(out, names=["id", "piece", "start", "n_words", "bin_id", "bin_offset"])

    packed = rests.groupBy("block").applyInArrow(run, f"id {items.schema['id'].dataType.simpleString()}, piece int, start long, n_words long, bin_id string, bin_offset long")
    name = F.concat_ws("-", F.lit("full"), F.hex(F.xxhash64("id", "source", "cluster", "words")), F.col("id").cast("string"), "copy", "piece")
    alone = full.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_words"), name.alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    return packed.unionByName(alone)
