"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from . import aggregates, documents, scalars, services, setup

_PARTS = (aggregates, scalars, documents, services, setup)


def queries() -> dict:
    return {name: q for part in _PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
