"""Collecting queries with their SQL."""

from __future__ import annotations


class Registered:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(f):
            self.queries[name or f.__name__] = f
            if sql:
                self.oracles[name or f.__name__] = sql
            return f

        return add


def sig(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"
