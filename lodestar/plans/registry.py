"""The queries of the library, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestar.plans import kept_oracles, kept_queries, oracles, queries, store_oracles, store_queries

FLAGSHIP = "hybrid_search"

QUERIES = queries.QUERIES | store_queries.QUERIES | kept_queries.QUERIES
ORACLES = oracles.ORACLES | store_oracles.ORACLES | kept_oracles.ORACLES
