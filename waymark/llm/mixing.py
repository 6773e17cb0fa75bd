"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Each source has a weight and may be repeated max_epochs times at most. The budget is shared by weight; sources whose share
exceeds their cap are clamped to it, and what they leave is shared again among the others by weight, until none is above
its cap. A source then takes all its rows floor(target / size) times, and the rest of its target from a seeded share of
its rows: rows are ordered by a hash of seed and identifier, and those before a cut stay once more. The cut is found from
sums over 4096 hash buckets per source and over the 4096 sub-buckets of the one bucket that the cut falls in, so no
source is ever sorted or gathered in one task.

Defined results: a null text has size 0; null is a source of its own, after all others; sources of size 0 get target 0; a
source without a weight gets weight 0. Repeated rows share one hash and so are taken alike. Empty input, empty output.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, n_words

MAX_EPOCHS = 3
BUCKETS = 4096


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def ranked_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size) with a weight each: the weights in turn, by the code points of the source, null last.

    Sources are ranked without gathering them: ranges of sources are numbered apart, then shifted by the counts before them.
    """
    order = [F.col("source").isNull(), F.col("source")]
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "source-ranges")
    # At most n rows, one per range.
    before = parts.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before") - 1
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return parts.join(before, "part").select("source", "source_size", turn.cast("long").alias("weight"))


def source_targets(sources: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) with the target of each. budget: words of the whole mix, by default those of all sources.

    Each round sends three sums to the driver. The level (words for one unit of weight) only rises, so the set of clamped
    sources is given by the level alone.
    """
    sources = materialize(sources.withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long")), "sources")
    exact = lambda c: c.cast("decimal(38,0)")
    cap = exact(F.col("source_size")) * max_epochs
    total = sources.agg(F.sum(exact(F.col("source_size")))).first()[0] or Decimal(0)
    budget = total if budget is None else Decimal(budget)
    clamped: Column = F.lit(False)
    free, weight, n = budget, Decimal(0), -1
    while True:
        left, weight, now = sources.agg(
            F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, exact(F.col("weight")))), F.coalesce(F.sum(clamped.cast("long")), F.lit(0))
        ).first()
        free, weight = budget - (left or 0), weight or Decimal(0)
        if now == n or not weight:
            break
        n = now
        clamped = (exact(F.col("weight")) * F.lit(free).cast("decimal(38,0)")).cast("double") > (cap * F.lit(weight).cast("decimal(38,0)")).cast("double")
    share = F.lit(0.0) if not weight else F.col("weight").cast("double") * F.lit(float(free)) / F.lit(float(weight))
    target = F.when(clamped, F.col("source_size").cast("double") * max_epochs).otherwise(share if weight else F.lit(0.0))
    return sources.withColumn("target", target)


def _hashes(id_col: Column, seed: int) -> list[Column]:
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    part = lambda at: F.conv(F.substring(h, at, 3), 16, 10).cast("int")
    return [part(1).alias("b1"), part(4).alias("b2")]


def plan(docs: DataFrame, weigh=ranked_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = 20) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken.

    weigh: takes (source, source_size) and returns it with a weight. size: by default the words of text_col.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(n_words(text_col) if size is None else size, F.lit(0)).cast("long").alias("size"))
    sized = materialize(sized.select("*", *_hashes(F.col("id"), seed)), "sized")
    goals = source_targets(weigh(source_sizes(sized)), budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = materialize(goals.withColumnRenamed("source", "src"), "targets")
    same = F.col("source").eqNullSafe(F.col("src"))

    def cut(sums: DataFrame, by: str) -> DataFrame:
        """The bucket of each source that holds the word at rest, and the words before it. At most BUCKETS rows a source."""
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(by))
        return sums.withColumn("upto", upto).join(goals, same).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))

    first = cut(sized.groupBy("source", "b1").agg(F.sum("size").alias("words")), "b1")
    first = materialize(first.select("src", F.col("b1").alias("cut1"), (F.col("upto") - F.col("words")).alias("before")), "cuts")
    at = sized.join(first, same & (F.col("b1") == F.col("cut1"))).groupBy("source", "before", "b2").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("b2")) + F.col("before")
    second = at.withColumn("upto", upto).join(goals, same).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    # The sub-bucket at the cut goes in if that brings the source nearer to its target.
    second = second.select("src", (F.col("b2") + F.when(F.col("rest") * 2 > F.col("upto") * 2 - F.col("words"), 1).otherwise(0)).alias("cut2"))
    cuts = materialize(goals.join(first.join(second.withColumnRenamed("src", "src2"), F.col("src").eqNullSafe(F.col("src2"))).drop("src2").withColumnRenamed("src", "src1"), F.col("src").eqNullSafe(F.col("src1")), "left").drop("src1"), "plan")
    more = (F.col("b1") < F.col("cut1")) | ((F.col("b1") == F.col("cut1")) & (F.col("b2") < F.col("cut2")))
    copies = F.least(F.col("whole") + F.coalesce(more.cast("long"), F.lit(0)), F.lit(max_epochs).cast("long"))
    return sized.join(cuts, same).select("id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **kw) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    names = fresh(docs, "wm_id", "wm_null", "wm_copies", "wm_copy")
    key = names[:2]
    named = lambda c: [F.coalesce(c.cast("string"), F.lit("")).alias(key[0]), c.isNull().alias(key[1])]
    # A row's fate follows from its source and identifier; sources differ only where identifiers repeat, so both are the key.
    names += fresh(docs, "wm_source", "wm_no_source")
    src = lambda c: [F.coalesce(c, F.lit("")).alias(names[4]), c.isNull().alias(names[5])]
    took = plan(docs, id_col=id_col, source_col=source_col, **kw).select(*named(F.col("id")), *src(F.col("source")), F.col("copies").alias(names[2])).dropDuplicates([*key, *names[4:]])
    out = docs.select("*", *named(F.col(id_col)), *src(F.col(source_col))).join(took, [*key, *names[4:]]).where(F.col(names[2]) > 0)
    return out.withColumn(names[3], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[2])))).select(*docs.columns)
