"""Where the query modules enter their queries."""

from __future__ import annotations

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def enter(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return enter
