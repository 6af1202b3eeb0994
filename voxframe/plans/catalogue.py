"""Named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from . import file_queries, log_queries, slab_queries, stream_queries, volume_queries

QUERIES: dict = volume_queries.QUERIES | log_queries.QUERIES | file_queries.QUERIES | slab_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL: dict[str, str] = volume_queries.SQL | log_queries.SQL | file_queries.SQL | slab_queries.SQL | stream_queries.SQL
