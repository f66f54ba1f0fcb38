"""The registered queries of the core library."""

from __future__ import annotations

from loopwright.plans import model_queries, queries, source_queries  # noqa: F401  they register themselves
from loopwright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
