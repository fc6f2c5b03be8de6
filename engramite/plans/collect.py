"""A decorator that keeps a query beside its oracle."""

from __future__ import annotations

from collections.abc import Callable


def registrar(queries: dict, oracles: dict) -> Callable:
    """``@query(sql)`` registers a function by its name; None means that SQL can't express it."""
    def query(sql: str | None) -> Callable:
        def register(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return register

    return query
