"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None, *views: str):
    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = (f"WITH {', '.join(views)} " if views else "") + sql
        return query

    return add


def rounded(c: Column | str, places: int = 4) -> Column:
    """Rounded, never -0."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + 0.0
