"""Collects queries and their SQL by name."""

from __future__ import annotations


class Registry:
    """queries: name -> (spark, folder) -> DataFrame; sql: name -> the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
