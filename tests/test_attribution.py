"""Boosted trees and the shares that Shapley values give their columns, on made-up rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from graphmill.functions import boosting
from graphmill.operators import attribution


def made(n=3000, seed=2):
    r = np.random.default_rng(seed)
    a, b, c = r.random(n), r.random(n), r.random(n)
    return pd.DataFrame({"k": np.arange(n), "a": a, "b": b, "noise": c, "layout": np.where(r.random(n) < 0.5, "x", "y"), "y": np.sin(6 * a) + 0.5 * (b > 0.4) + 0.05 * r.normal(size=n)})


def test_trees_learn_what_lines_cannot():
    pdf = made()
    held = np.arange(len(pdf)) % 5 == 0
    x, y = pdf[["a", "b", "noise"]].to_numpy(), pdf.y.to_numpy()
    assert boosting.held_out_r2(x, y, held) > 0.9
    assert boosting.held_out_r2(x[:, 2:], y, held) < 0.05 and abs(boosting.held_out_r2(x[:, :0], y, held)) < 0.05
    assert boosting.held_out_r2(x, np.ones(len(y)), held) == 0.0


def test_shares_add_up(spark):
    pdf = made()
    pdf.loc[:20, "y"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, a double, b double, noise double, layout string, y double")
    df = df.selectExpr("*", "cast(null as double) AS never")
    groups = {"a": ["a"], "b": ["b"], "noise": ["noise"]}
    got = {(r.metric, r.feature): r.share for r in attribution.shapley_boosted(df, ["y", "never"], groups, ["k"], layout="layout").collect()}
    assert {m for m, _ in got} == {"y"} and abs(sum(got.values()) - 1) < 1e-6
    assert got["y", "a"] > got["y", "b"] > 0.05 > abs(got["y", "noise"]) and abs(got["y", "layout"]) < 0.05
    again = {(r.metric, r.feature): r.share for r in attribution.shapley_boosted(df.repartition(7), ["y"], groups, ["k"], layout="layout").collect()}
    assert all(abs(again[k] - v) < 1e-9 for k, v in got.items())
    with pytest.raises(ValueError, match="8 groups"):
        attribution.shapley_boosted(df, ["y"], {str(i): ["a"] for i in range(9)}, ["k"])


def test_distributed_fit(spark):
    df = spark.createDataFrame(made())
    ((name, r2, n, m),) = attribution.held_out_fit(df, ["y"], ["a", "b", "noise"], ["k"])
    assert name == "y" and r2 > 0.8 and n + m == 3000 and 450 < m < 750
    assert attribution.held_out_fit(df.limit(50), ["y"], ["a"], ["k"])[0][1] is None
