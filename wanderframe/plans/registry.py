"""A registry of queries for the modules of this package."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Register a function (spark, sf_dir) under its name, with its SQL."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add
