"""Named queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its checking SQL where SQL can say it."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return add


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def finding(
    source: str, scanner: str, kind: str, level: str, score: str, cwe: str | None, cve: str | None = None, **more: str
) -> str:
    """Select list of a flattened finding; kind, level and score are SQL."""
    columns = [
        f"{source} AS source", f"{q(scanner)} AS scanner", f"{kind} AS vulnerability_type", f"{level} AS level",
        f"CAST({score} AS DOUBLE) AS cvss_score",
        f"{q(cwe) if cwe and not cwe.startswith('@') else (cwe[1:] if cwe else 'CAST(NULL AS VARCHAR)')} AS cwe_id",
        f"{q(cve) if cve and not cve.startswith('@') else (cve[1:] if cve else 'CAST(NULL AS VARCHAR)')} AS cve_id",
    ]
    return ", ".join(columns + [f"CAST({sql} AS VARCHAR) AS {name}" for name, sql in more.items()])


def table_of(rows: list[tuple], alias: str, columns: str) -> str:
    """An inline table for the checking engine."""
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}({columns})"
