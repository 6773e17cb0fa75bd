"""Tables written to the shared folder and read again: where lineage ends and work is not done twice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .scratch import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
