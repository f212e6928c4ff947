"""All queries on the reference operators, with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from . import registry

for _name in ("q_corpus", "q_drawings", "q_tables", "q_analysis", "q_algorithms", "q_more", "q_sources"):
    importlib.import_module(f"{__package__}.{_name}")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    from .q_corpus import flagship

    return flagship(spark, sf)


def queries() -> dict[str, registry.Query]:
    """All queries by name."""
    return dict(registry.QUERIES)


def sql() -> dict[str, str]:
    """SQL of the queries that it can express."""
    return dict(registry.SQL)
