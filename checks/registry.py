"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import with_place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL twin if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def r(name: str | Column, places: int = 6) -> Column:
    """Rounded value; adding zero turns a negative zero into a positive one."""
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column, places) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, places) for n in names})


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


def days(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text, which reads the same from every engine."""
    return df.withColumns({n: day(n) for n in names})


def numbered(df: DataFrame, shown=lambda x: x) -> DataFrame:
    """Rows with their ``place`` in the order in which the operator gives them, from 1. ``shown`` keeps the column."""
    return shown(with_place(df))
