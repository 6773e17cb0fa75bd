"""All registered queries of the trajectory and map engine, with their SQL."""

from __future__ import annotations

from . import io_queries, map_queries, network_queries, quality_queries, topology_queries, trajectory_queries

MODULES = [trajectory_queries, network_queries, map_queries, quality_queries, topology_queries, io_queries]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in MODULES for k, v in m.SQL.items()}
FLAGSHIP = trajectory_queries.clean_pipeline
