"""Registry of named queries: name -> (function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Filled by decorators, in order of definition."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def put(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is there already")
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return put

    def merge(self, other: "Registry") -> "Registry":
        for k, f in other.queries.items():
            self.add(other.sql.get(k), k)(f)
        return self
