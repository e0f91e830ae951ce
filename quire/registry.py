"""The engine's registered queries and their SQL."""

from __future__ import annotations

from . import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.SQL)
