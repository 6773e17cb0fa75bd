"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name: 0, 1, ... in the order given, which must tell rows apart.

    Ranges of rows are numbered apart and shifted by the counts before them. Ranges are drawn from a sample, so they are
    written to the shared folder once, for both uses to see the same ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_part").count()  # one row for each range
    sizes = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.join(sizes, "_part").withColumn(name, at.cast("long")).drop("_part", "_before")
