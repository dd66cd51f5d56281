"""All queries of the engine and their SQL."""

from __future__ import annotations

from fotolake.plans import edit_queries, rest_queries, scalar_queries, source_queries, store_queries, tag_queries  # noqa: F401 (they register their queries)
from fotolake.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
