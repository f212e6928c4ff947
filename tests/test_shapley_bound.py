"""shapley_r2 takes all layouts or none."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphmill.operators import analysis


def test_too_many_layouts_are_an_error(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("layout"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    with pytest.raises(ValueError, match="more than 1000"):
        analysis.shapley_r2(df, "y", {"x": ["x"]}, layout="layout")


def test_the_bound_itself_is_taken(spark, monkeypatch):
    monkeypatch.setattr(analysis, "MOST_LAYOUTS", 3)
    df = spark.range(30).select((F.col("id") % 3).cast("string").alias("layout"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    assert abs(sum(share for _, share in analysis.shapley_r2(df, "y", {"x": ["x"]}, layout="layout")) - 1) < 1e-9
