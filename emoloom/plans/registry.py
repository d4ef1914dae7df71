"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _counted(sql: str) -> str:
    """``count_if(x)`` as ``count(*) FILTER (WHERE x)``, which is a 64-bit integer in every engine."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 0, start + len("count_if")
        quoted = False
        while True:
            c = sql[end]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if depth == 0:
                    break
            end += 1
        out += [sql[at:start], "(count(*) FILTER (WHERE ", _counted(sql[start + len("count_if(") : end]), "))"]
        at = end + 1
    return "".join(out) + sql[at:]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        own = name or f.__name__
        QUERIES[own] = f
        if sql is not None:
            SQL[own] = _counted(sql)
        return f

    return register
