"""Name -> query, name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn
    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits, so that the order of floating-point sums does not show."""
    return df.withColumns({c: r6(F.col(f"`{c}`")) for c in columns})

