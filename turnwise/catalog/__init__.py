"""Registered queries with the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a `(spark, sf_dir) -> DataFrame` under a name, with its SQL if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    from turnwise.catalog import cohorts, logs, scalars, sessions, statistics  # noqa: F401
