"""Embedding whitening with MLlib's BlockMatrix: the covariance by a distributed product, its eigenvectors at the driver, the
projection by another distributed product.

Each distinct vector is fitted once, so copies don't weigh on the model. The distinct vectors are numbered, centred and cut
into stripes of at most STRIPE_CELLS numbers; a stripe is one BlockMatrix, whose product with itself is dealt over tasks
along its rows (the number of mid-dimension splits). What reaches the driver is one matrix of dimension by dimension per
stripe. A product with a narrow matrix has as many tasks as the square root of the partitions of its factor, so each stripe's
rows come in the square of the tasks wanted; that bounds what a task holds by a stripe's share, however many stripes there are.

Defined results: rows with a null vector or a null or non-finite entry are left out; an entry that is missing in a shorter
vector is 0; 64 * entry is held within 2**40 on both sides. deviation is null where it exceeds a long. A component without
variance has whitened null and is left out of identity_error. Repeated rows and identifiers are answered row by row; an empty
table gives no rows; other columns never matter.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..sources.scratch import scratch_path
from .common import materialize, spread_join

#: Numbers in a stripe, and in one block of it (a block of doubles has 4 MB).
STRIPE_CELLS, BLOCK_CELLS = 1 << 27, 1 << 19
#: Row blocks that one task of a product takes.
TASK_BLOCKS = 4
#: Scale and shift of the integers, and the bound of the scaled entries.
SCALE, SHIFT, BOUND = 64, 1_000_000, 1 << 40


def quantised(vector: str) -> Column:
    """floor(64 * c) + 1000000 of each entry; null if the vector is null or an entry is null or not finite."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("long") + SHIFT)
    return F.when(~bad, held)


def block_matrix(rows: DataFrame, n: int, d: int, rows_per_block: int) -> BlockMatrix:
    """rows: place long (0 to n - 1), v array<double> of length d."""
    blocks = -(-n // rows_per_block)
    tasks = -(-blocks // TASK_BLOCKS)
    vectors = rows.repartition(tasks * tasks, "place").select(F.col("place"), array_to_vector("v").alias("v"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, d).toBlockMatrix(rows_per_block, d)


def scatter(m: BlockMatrix) -> np.ndarray:
    """The product of m's transpose and m, whose row blocks are dealt over tasks."""
    turned = m.transpose()
    splits = -(-m.numRowBlocks // TASK_BLOCKS)
    product = turned._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def projected(m: BlockMatrix, w: np.ndarray, spark: SparkSession) -> DataFrame:
    """place, y: the rows of m times w."""
    d, k = w.shape
    blocks = spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, w.flatten(order="F").tolist()))], 1)
    product = m.multiply(BlockMatrix(blocks, d, k))
    rows = product.toIndexedRowMatrix().rows.map(lambda r: (r.index, r.vector.toArray().tolist()))
    return spark.createDataFrame(rows, "place long, y array<double>", verifySchema=False)


class Stripes:
    """A table of number and v (array<double> of length d), n rows numbered from 0, as BlockMatrix stripes."""

    def __init__(self, table: DataFrame, n: int, d: int, stripe_cells: int) -> None:
        self.n, self.d = n, d
        self.block = max(1, min(BLOCK_CELLS, stripe_cells) // d)
        self.size = max(1, stripe_cells // d // self.block) * self.block
        self.count = -(-n // self.size)
        self.spark = table.sparkSession
        path = scratch_path(self.spark, "stripes")
        # One folder for each stripe, so that each is read alone.
        table.withColumn("stripe", F.floor(F.col("number") / self.size).cast("int")).write.partitionBy("stripe").parquet(path)
        self.table = self.spark.read.schema("number long, v array<double>, stripe int").parquet(path)

    def matrix(self, i: int) -> BlockMatrix:
        rows = self.table.where(F.col("stripe") == i)
        size = min(self.size, self.n - i * self.size)
        return block_matrix(rows.select((F.col("number") - i * self.size).alias("place"), "v"), size, self.d, min(self.block, size))

    def covariance(self) -> np.ndarray:
        total = sum(scatter(self.matrix(i)) for i in range(self.count)) / self.n
        return (total + total.T) / 2

    def projected(self, w: np.ndarray) -> DataFrame:
        """number, y; written to the shared folder."""
        parts = [projected(self.matrix(i), w, self.spark).select((F.col("place") + i * self.size).alias("number"), "y") for i in range(self.count)]
        return materialize(functools.reduce(DataFrame.unionAll, parts), "projected")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, stripe_cells: int = STRIPE_CELLS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row with a vector and each component."""
    rows = rows.select(F.col(id_col).alias("id"), quantised(vector_col).alias("x")).where(F.col("x").isNotNull())
    d, shortest = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if not d:
        kinds = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.where(F.lit(False)).select("id", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    if shortest < d:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(d) - F.size("x"))))
    fit = numbered(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), [F.xxhash64("x"), F.col("x")], "number")
    fit = materialize(fit, "fit-list")
    n, *sums = fit.agg(F.count(F.lit(1)), *(F.sum(F.get("x", F.lit(i))) for i in range(d))).first()
    sums = F.lit([int(s) for s in sums])
    away = F.transform("x", lambda x, i: F.try_subtract(F.try_multiply(x, F.lit(n)), F.get(sums, i)))
    centred = F.transform(away, lambda a, i: F.coalesce(a.cast("double") / n, F.get("x", i).cast("double") - F.get(sums, i) / n))
    stripes = Stripes(fit.select("number", centred.alias("v")), n, d, stripe_cells)
    covariance = stripes.covariance()
    values, vectors = np.linalg.eigh(covariance)
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(covariance))
    k = min(d, components)
    varied = int(np.sum(values[:k] > values[0] * d * 1e-14))
    if varied:
        y = stripes.projected(vectors[:, :varied] / np.sqrt(values[:varied]))
        means = y.agg(*(F.avg(F.get("y", F.lit(i))) for i in range(varied))).first()
        middle = F.lit([float(m) for m in means])
        again = Stripes(y.select("number", F.transform("y", lambda a, i: a - F.get(middle, i)).alias("v")), n, varied, stripe_cells)
        error = float(np.abs(again.covariance() - np.eye(varied)).max())
    else:
        y, error = fit.select("number", F.array().cast("array<double>").alias("y")), None
    deviation = F.aggregate(away, F.lit(0).cast("long"), lambda s, a: F.try_add(s, F.try_multiply(a, a)))
    model = fit.select("number", "x", deviation.alias("deviation")).join(y, "number").drop("number")
    out = spread_join(rows, model, "x", counted=fit.select("x", F.col("copies").alias("n")))
    explained = F.lit([float(v) / trace if trace else 0.0 for v in np.maximum(values[:k], 0)])
    out = out.withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(k))))
    at = F.col("component") - 1
    return out.select(
        "id", F.col("component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.get("y", at).alias("whitened"),
        F.get(explained, at).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
