"""All registered queries on the driver's tables, with the DuckDB statement of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) and its DuckDB statement."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


from . import q_graph, q_lines, q_more, q_relational, q_roads, q_rules, q_scalar, q_spatial, q_track  # noqa: E402, F401
