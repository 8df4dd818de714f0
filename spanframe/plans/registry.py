"""Registry of named queries: each is (session, table folder) -> DataFrame, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def register(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: names are unique; ``sql`` is the equivalent over the same tables."""

        def add(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered twice; known: {', '.join(sorted(self.queries))}")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return add


#: Queries of the engine's own operators.
CORE = Registry()
