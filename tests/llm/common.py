"""Small tables for the operators' edge cases."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at dusk"


def words(n: int, seed: int) -> list[str]:
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, very long, tied and repeated rows."""
    long_text = " ".join(words(30_000, 1))
    return [
        (1, PROSE, "en", "a", 10),
        (2, PROSE, "en", None, None),
        (2, PROSE, "en", None, None),
        (3, None, None, "b", None),
        (4, "", "en", "b", 0),
        (None, PROSE, "en", "a", 1),
        (None, None, None, None, None),
        (5, " \n\t ", "de", "c", 4),
        (6, long_text, "en", "a", len(long_text)),
        (7, long_text + " end", "en", "a", 1),
        (8, "12 345 !?", "en", "c", 9),
        (9, "Ünïcode 日本語 😀 <|endoftext|>", "fr", "ß", 5),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """df with columns that operators might use inside."""
    from pyspark.sql import functions as F

    for c in ("id", "sha", "run", "node", "size", "copies", "kept", "wm_sha", "WM_ID", "wm_t", "label", "n", "bucket", "source_size"):
        df = df.withColumn(c, F.lit("x"))
    return df
