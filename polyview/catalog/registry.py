"""Registry of runnable queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sequential greedy matching per group: edges {g, k, s} in order, kept when both ends are free.
NONE = "list_filter([{'g': es[1].g, 'k': es[1].k, 's': es[1].s}], lambda q: false)"
GREEDY = f"""list_reduce(list_prepend({NONE}, list_transform(es, lambda q: [q])), lambda acc, o:
 CASE WHEN len(list_filter(acc, lambda q: q.g=o[1].g OR q.k=o[1].k))>0 THEN acc ELSE list_concat(acc, o) END)"""

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without ``sql`` the query is tested by brute force."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def r6(col: Column, name: str, digits: int = 6) -> Column:
    """Round for comparison; adding zero folds -0.0 into 0.0."""
    return (F.round(col, digits) + F.lit(0.0)).alias(name)
