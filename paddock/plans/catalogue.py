"""Every registered query of the reference's own operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from paddock.plans import frame_queries, lookup_queries, store_queries, visit_queries

PARTS = (lookup_queries, visit_queries, frame_queries, store_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
