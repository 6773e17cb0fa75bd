"""Line deduplication over overlapping three-line windows (DataFrame functions only).

A text is split at line feeds. Every three consecutive lines form a window, known by two 64-bit hashes of its lines. A
window met before, at a smaller (identifier, line) place anywhere in the corpus, is a later occurrence; the lines that later
occurrences cover are merged and removed. The first occurrence of any line always stays.

Defined results: windows whose lines are all blank (white space only) are no windows; texts of fewer than three lines stay
as they are; a null text stays null with no lines; a text whose lines all go becomes the empty text. Null identifiers come
after all others. Rows repeated with the same identifier are told apart by a hash of their text; fully repeated rows share
one place and so keep or lose their lines together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, spread_join

WINDOW = 3


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per window: place (identifier with nulls last, text hash), line number from 0, both hashes as key."""
    lines = F.split(F.col(text_col), "\n", -1)
    at = docs.select(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), lines.alias("lines")).where(F.size("lines") >= WINDOW)
    window = lambda i: F.slice(F.col("lines"), i + 1, WINDOW)
    blank = lambda w: ~F.array_join(w, "").rlike(r"\S")
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW),
        lambda i: F.when(~blank(window(i)), F.struct(i.alias("line"), F.xxhash64(window(i)).alias("h1"), F.xxhash64(F.lit(3), window(i)).alias("h2"))),
    )
    return at.select("no_id", "id", "t", F.explode(F.array_compact(hashed)).alias("w")).select("no_id", "id", "t", "w.line", F.struct("w.h1", "w.h2").alias("key"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text that loses lines: no_id, id, t (its text hash), gone (sorted line numbers)."""
    windows = _places(docs, id_col, text_col)
    place = F.struct("no_id", "id", "t", "line")
    # One row per distinct window; copies of a window are counted before the exchange.
    repeated = materialize(windows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-windows")
    later = spread_join(windows, repeated.drop("n"), "key", counted=repeated).where(place > F.col("first"))
    # The lines of one text: bounded by the text itself.
    return later.groupBy("no_id", "id", "t").agg(F.collect_set("line").alias("starts")).select(
        "no_id", "id", "t", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))).alias("gone")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """docs with the repeated lines gone from text_col, and two columns of counts under the given names."""
    a, b, c, gone, lines = fresh(docs, "wm_no_id", "wm_id", "wm_t", "wm_gone", "wm_lines")
    cut = removed_lines(docs, id_col, text_col).select(F.col("no_id").alias(a), F.coalesce(F.col("id").cast("string"), F.lit("")).alias(b), F.col("t").alias(c), F.col("gone").alias(gone))
    mine = docs.select("*", F.col(id_col).isNull().alias(a), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(b), F.xxhash64(text_col).alias(c))
    out = mine.join(cut, [a, b, c], "left").withColumn(lines, F.split(F.col(text_col), "\n", -1))
    # What lies between the gone lines, piece by piece: each line is looked at once, however many go. The lines are bound by
    # the outer lambda, so that they are split once.
    pieces = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(F.col(gone), F.array(F.size(lines))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    pieces = F.filter(pieces, lambda g: g["q"] - g["p"] > 1)
    left = F.transform(F.array(F.col(lines)), lambda all_: F.array_join(F.flatten(F.transform(pieces, lambda g: F.slice(all_, g["p"] + 2, g["q"] - g["p"] - 1))), "\n"))[0]
    keep = {text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)}
    counts = {n_lines: F.coalesce(F.size(lines), F.lit(0)), n_removed: F.coalesce(F.size(gone), F.lit(0))}
    counts = {k: F.when(F.col(text_col).isNull(), 0).otherwise(v).cast("long") for k, v in counts.items()}
    return out.select(*[keep.get(x, F.col(x)).alias(x) for x in docs.columns if x not in counts], *[v.alias(k) for k, v in counts.items()])
