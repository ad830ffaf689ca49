"""Where queries and their DuckDB equals are registered."""

from __future__ import annotations

from collections.abc import Callable

from . import views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_views: bool = True):
    """Registers a function of (spark, sf_dir) under ``name``. ``sql`` may begin with common table expressions, ended by a blank line."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {views.SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if with_views else sql
        return f

    return add
