"""The register."""

from __future__ import annotations

from collections.abc import Callable

from .roles import with_roles

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *roles: str) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame by its name, with SQL over the roles named."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_roles(sql, *roles) if roles else sql
        return f

    return add
