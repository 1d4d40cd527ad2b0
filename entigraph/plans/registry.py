"""Registered queries: a name, a function of (spark, sf_dir), and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import GRAPH_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``graph``: the SQL may name the derived entities and relationships."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = f"{GRAPH_SQL}{'' if sql.lstrip().startswith(',') else ' '}{sql}" if graph else sql
        return f

    return add
