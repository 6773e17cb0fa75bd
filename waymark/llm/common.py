"""What the operators of this subpackage share: shared-folder tables, fresh column names, grouping keys for nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Separators of words: the space and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame | list[str], *bases: str) -> list[str]:
    """Column names that df (or a list of names) does not have; Spark compares names without regard to case."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    out = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def one_per_key(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """columns of one row for each key: of several the one whose hash is smallest, so that reruns agree."""
    whole = F.struct(*columns)
    return rows.groupBy(*key).agg(F.min_by(whole, F.xxhash64(*columns)).alias("wm_row")).select("wm_row.*")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str) -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


#: A key is hot beyond so many rows, or beyond the share of all rows that at most HOT_KEYS keys can reach.
HOT_ROWS, HOT_KEYS, FEW_ROWS = 10_000, 50_000, 100_000


def spread_join(many: DataFrame, one: DataFrame, key: str, counted: DataFrame | None = None, rows: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """many joined with one, which has one row per key at most, where a key may hold any share of the rows of many.

    Rows of a hot key are dealt over parts by a hash of the whole row, and the row of one is copied to each part. The list of
    hot keys has HOT_KEYS rows at most, whatever the input's size, so it may be broadcast. counted: a table with the keys of
    many, one row each, and their number n, if it is at hand; else many is counted. rows: the number of rows of many, if it is
    known: a table of FEW_ROWS or fewer fits a task whatever its keys are and is joined as it is. hot_rows: in place of HOT_ROWS.
    """
    if rows is not None and rows <= FEW_ROWS:
        return many.join(one, key)
    salt, parts, n = fresh([*many.columns, *one.columns], "wm_salt", "wm_parts", "wm_n")
    per_key = counted.select(key, F.col("n").alias(n)) if counted is not None else many.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    total, most = per_key.agg(F.sum(n), F.max(n)).first()
    least = max(hot_rows or HOT_ROWS, -(-(total or 0) // HOT_KEYS))
    if (most or 0) <= least:
        return many.join(one, key)
    hot = materialize(per_key.where(F.col(n) > least).select(key, F.ceil(F.col(n) / least).cast("int").alias(parts)), "hot-keys")
    hot = F.broadcast(hot)
    mine = many.join(hot, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col(parts)).cast("int"), F.lit(0))).drop(parts)
    theirs = one.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return mine.join(theirs, [key, salt]).drop(salt)
