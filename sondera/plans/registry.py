"""A family's queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return put


def r6(c, alias: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(alias) if alias else F.round(c, 6)


def rounded(df, *cols: str):
    """df with the named numbers rounded to six places."""
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))
