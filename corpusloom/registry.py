"""All registered queries of the library and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "e46_retrieve"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query; sql is DuckDB SQL with the same rows, in which {view} names a view of the application model."""
    from .sources.model import with_views

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return query

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from .plans import document_queries, graph_queries, insight_queries, pipeline_queries, retrieval_queries, stream_queries, table_queries, wiki_queries  # noqa: F401
