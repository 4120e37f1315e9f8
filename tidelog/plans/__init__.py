"""The registered queries over the reference's operators, each with SQL for an oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function by its name, with the SQL that must give the same rows."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


from . import entity_queries, event_queries, metric_queries, stream_queries  # noqa: E402, F401
