"""How queries are registered: a function of the discourse tables, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .bridge import Bridge, with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers `run(bridge) -> DataFrame` under its name; `sql` may name the bridge's views."""

    def add(run: Callable[[Bridge], DataFrame]):
        name = run.__name__
        if name in QUERIES:
            raise ValueError(f"two queries {name}")
        QUERIES[name] = lambda spark, sf_dir: run(Bridge(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return run

    return add
