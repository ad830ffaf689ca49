"""Registered queries of the corpus operators and equal DuckDB SQL."""

from __future__ import annotations

from .plans import corpus_queries, stats_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "g01_query_collocations"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
