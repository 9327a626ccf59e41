"""All queries of the engine's own operators, by name, with their DuckDB SQL."""

from __future__ import annotations

from quillspark.plans import item_queries, script_queries, server_queries, session_queries, source_queries, text_queries  # noqa: F401  (registers its queries)
from quillspark.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "carry_over_tiers"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
