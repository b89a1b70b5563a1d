"""Registered queries: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under ``name`` with its SQL twin."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = (f, sql)
        return f

    return add
