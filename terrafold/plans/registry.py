"""Registering queries next to the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..views import with_views


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, views: str = "", sql: str | None = None):
        def add(fn: Callable) -> Callable:
            self.queries[fn.__name__] = fn
            if sql:
                self.oracles[fn.__name__] = with_views(views, sql) if views else sql
            return fn

        return add


def rounded(df: DataFrame, columns: str, digits: int = 6) -> DataFrame:
    """The named columns rounded (and -0.0 as 0.0), the others as they are."""
    names = columns.split()
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns))
