"""Choices between distances that differ in their last bits only, against the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_votes_between_edges_upon_each_other(spark, tmp_path):
    """Three objects whose base edges overlap on one line: both run through the foot of a point, and the SQL sorts their
    distances by all bits."""
    import duckdb

    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where(F.col("user_id").isin(4, 781, 858))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(x) for x in entry.queries()["fus_votes"](spark, str(tmp_path)).select("region", "node", "other", "eid", "n").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = set(con.execute(f"SELECT region, node, other, eid, n FROM ({entry.oracle_sql()['fus_votes']})").fetchall())
    assert got == want
