"""A small registry: a module's queries with their SQL twins."""

from __future__ import annotations

from tessera.runtime import Opened


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        """Register the decorated (spark, data directory) -> DataFrame under its own name, with its SQL if there is any."""

        def add(f):
            n = name or f.__name__
            self.queries[n] = lambda spark, d: f(Opened(spark), d)
            if sql is not None:
                self.oracles[n] = sql
            return f

        return add
