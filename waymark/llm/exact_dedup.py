"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every row gets a SHA-256 digest of its text and belongs to one run, chosen by its identifier, so copies of one text are
dealt over all runs. A run holds one row per (digest, identifier), in the order of digests. The rounds are binomial: in round
r, runs whose numbers differ in bit r alone exchange what they hold. Rows of both runs are merged in order of digest by a
sort aggregate; equal digests meet, and of each the largest identifier and the number of rows stay. Digests count as equal
only with equal byte length and an equal second, independent 64-bit hash, at every level. Each level is written, in order,
to the shared folder. After the last round one run holds one row per text; the decision then travels down the same tree, so
that no join key ever holds more than the two rows of a digest, or, at the leaves, one run's share of a group of copies.

Defined results: a null text equals the empty text; a null identifier loses against any other; if all are null, keep_id
is null; of rows repeated with the same identifier and text exactly one is kept, and if they differ in other columns, the one
whose row has the smallest hash. Other columns are never looked at otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, one_per_key, text_of

KEY = ["sha", "check", "n_bytes"]


def _digested(docs: DataFrame, text_col: str) -> list:
    text = text_of(text_col)
    return [F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(F.lit(7), text).alias("check"), F.octet_length(text).alias("n_bytes")]


def digest_runs(docs: DataFrame, id_col: str, text_col: str, n_runs: int) -> DataFrame:
    """One row per (run, digest, identifier) with the number n of such rows, sorted by digest within each partition."""
    rows = docs.select(F.col(id_col).alias("id"), *_digested(docs, text_col))
    return (
        rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_runs)).cast("int").alias("run"), *KEY, "id")
        .agg(F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("run", "sha")
    )


def _merged(rows: DataFrame, run: Column) -> DataFrame:
    """One level: run, digest, best (whether there is an identifier, and the largest), total; in order within each task. The
    largest of a struct takes a sort aggregate, which merges rows in order of run and digest on both sides of the exchange."""
    level = rows.groupBy(run.alias("run"), *KEY).agg(F.max("best").alias("best"), F.sum("total").alias("total"))
    return materialize(level, "digest-level")


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_runs: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, sha (binary).

    n_runs is raised to a power of two; by default it follows spark.sql.shuffle.partitions, so that a group of copies is
    dealt over at least as many leaves as there are tasks.
    """
    wanted = n_runs or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, (wanted - 1).bit_length())
    leaves = materialize(digest_runs(docs, id_col, text_col, 1 << rounds), "digest-runs")

    best = F.struct(F.col("id").isNotNull().alias("there"), "id").alias("best")
    levels = [_merged(leaves.select("run", *KEY, best, F.col("n").alias("total")), F.col("run"))]
    partner = lambda r: F.col("run").bitwiseAND(~(1 << r)).cast("int")
    for r in range(rounds):
        levels.append(_merged(levels[-1], partner(r)))

    # Down: each level learns the decision of the run that its own was merged into.
    decided = levels[-1].select("run", *KEY, F.col("best.id").alias("keep_id"), F.col("total").alias("group_size"))
    for r in reversed(range(rounds)):
        below = levels[r].select(partner(r).alias("parent"), F.col("run").alias("child"), *KEY)
        decided = below.join(decided.withColumnRenamed("run", "parent"), ["parent", *KEY]).select(F.col("child").alias("run"), *KEY, "keep_id", "group_size")
        if r and r % 4 == 0:
            decided = materialize(decided, "digest-decided")
    return (
        leaves.join(decided, ["run", *KEY])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_runs: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    key = fresh(docs, "wm_sha", "wm_id", "wm_null")
    named = lambda i, s: [s.alias(key[0]), F.coalesce(i.cast("string"), F.lit("")).alias(key[1]), i.isNull().alias(key[2])]
    winners = assignments(docs, id_col, text_col, n_runs).where("kept").select(*named(F.col("id"), F.col("sha")))
    mine = docs.select("*", *named(F.col(id_col), _digested(docs, text_col)[0]))
    return one_per_key(mine.join(winners, key, "left_semi"), key, docs.columns)
