"""Named queries: each is a function over `Tables`, most with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.mappings import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r6(col, name: str | None = None) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    out = F.round(col, 6)
    return out.alias(name) if name else out


def us(col: str, name: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp")).alias(name)


def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: fn(Tables(spark, path))
