"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import analysis_queries, encoder_queries, game_queries, log_queries, model_queries  # noqa: F401  the others add their own to the last's tables


def queries() -> dict[str, Callable]:
    return dict(log_queries.Q)


def oracle_sql() -> dict[str, str]:
    return dict(log_queries.SQL)
