"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} exists")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str, raw: bool = False) -> DataFrame:
    """A table of the corpus; NaN is null unless it is asked for raw."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df if raw else df.select(*(number(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))
