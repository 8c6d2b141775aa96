"""Registered queries: name -> (function of session and folder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable) -> Callable:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add
