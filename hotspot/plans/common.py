"""Helpers shared by the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_places(c, places: int = 6):
    """round(x * 10^p) / 10^p on the binary value — the same double the SQL oracle's
    round(x, p) yields, also on exact ties (plain Spark round decides ties on the
    shortest decimal string instead)."""
    m = float(10**places)
    return F.round(c * F.lit(m)) / F.lit(m)


def round6(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (the oracle compares at 6 decimals)."""
    cols = [
        round_places(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None):
        def deco(fn):
            if key in self.queries:
                raise KeyError(f"duplicate query key {key}")
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return deco
