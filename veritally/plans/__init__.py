"""Queries of the engine over the driver's tables, with their twins in SQL."""

from __future__ import annotations

from .registry import Query


def _modules() -> list:
    from . import chain, facts, lookups, readers, reading, relational, roundtrips, scalars, sinks, spatial, stores, target

    return [scalars, relational, reading, lookups, chain, facts, target, stores, roundtrips, readers, spatial, sinks]


def queries() -> dict[str, Query]:
    return {name: query for m in _modules() for name, query in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.R.sql.items()}
