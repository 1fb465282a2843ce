"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL of the same columns where there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def greedy_sql(pairs: str, order: str) -> str:
    """CTEs up to m (frame, a, b): per frame the pairs in order, each taken if both its sides are free."""
    taken = "list_contains(w.l, pr.a) OR list_contains(w.r, pr.b)"
    return f"""RECURSIVE pr AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {order}, a, b) AS k, count(*) OVER (PARTITION BY frame) AS n FROM ({pairs})),
  w AS (SELECT frame, k, n, [a] AS l, [b] AS r FROM pr WHERE k = 1 UNION ALL SELECT w.frame, pr.k, w.n, CASE WHEN {taken} THEN w.l ELSE list_append(w.l, pr.a) END, CASE WHEN {taken} THEN w.r ELSE list_append(w.r, pr.b) END FROM w JOIN pr ON pr.frame = w.frame AND pr.k = w.k + 1),
  m AS (SELECT frame, unnest(l) AS a, unnest(r) AS b FROM w WHERE k = n)"""
