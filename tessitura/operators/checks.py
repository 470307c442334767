"""Strict checks: a DataFrame that must be empty, and the error that quotes a few of its rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class CheckError(ValueError):
    pass


def require_empty(offending: DataFrame, message: str, show: int = 5) -> None:
    rows = offending.take(show)
    if rows:
        raise CheckError(f"{message}: {[tuple(r) for r in rows]}")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, *keys: str, what: str = "rows") -> DataFrame:
    require_empty(repeated(df, *keys), f"duplicate {what}")
    return df


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in order; a test that evaluates to null counts as holding."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items()]))
