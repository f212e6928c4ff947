"""How much of a score boosted trees explain, and which groups of columns they owe it to, on rows that they haven't seen."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boosting
from ..seeds import unit
from .analysis import MOST_LAYOUTS

#: Rows that the fits of all subsets are made on, at most: those of least hash.
SAMPLE = 60_000
#: The share of rows that is held out, and the least number of rows for a fit.
HELD, LEAST = 0.2, 100


def _hash(seed: str, key: list[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in key)))


def held_out_fit(df: DataFrame, targets: list[str], features: list[str], key: list[str], seed: str = "fit", trees: int = 20, depth: int = 4) -> list[tuple[str, float | None, int, int]]:
    """(target, R2 on the rows held out, rows fitted, rows held out) of boosted trees on all rows, by Spark's distributed fit.
    A fifth of the rows, by the hash of key, is held out, so reruns and partitions don't matter. Rows that lack the target or a
    feature are left out; of fewer than LEAST rows, R2 is None."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler, out = VectorAssembler(inputCols=features, outputCol="__x"), []
    for t in targets:
        rows = df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(t).cast("double").alias("__y"), (unit(_hash(seed, key), 1) < HELD).alias("__held")).dropna()
        fit, rest = (assembler.transform(rows.filter(h)).select("__x", "__y") for h in ("NOT __held", "__held"))
        n, m = fit.count(), rest.count()
        r2 = None
        if n + m >= LEAST and n and m:
            model = GBTRegressor(featuresCol="__x", labelCol="__y", maxIter=trees, maxDepth=depth, seed=7).fit(fit)
            r2 = RegressionEvaluator(labelCol="__y", metricName="r2").evaluate(model.transform(rest))
        out.append((t, r2, n, m))
    return out


def shapley_boosted(df: DataFrame, targets: list[str], groups: dict[str, list[str]], key: list[str], layout: str | None = None, seed: str = "shapley", sample: int = SAMPLE) -> DataFrame:
    """(metric, feature, share): exact Shapley values, over all subsets of the groups of columns (at most 8), of the R2 that
    boosted trees reach on held-out rows (0 without a column), and "residual" = 1 - R2 of all. With layout, its values are one more group, one-hot.

    The fits are made on a bounded sample: the sample rows of least hash of key that have all columns. Each fit is one task
    (a target and a subset), so 2 ** groups times targets of them run side by side. A target of fewer than LEAST rows
    has no row.
    """
    groups, spark = dict(groups), df.sparkSession
    if len(groups) + bool(layout) > 8:
        raise ValueError("at most 8 groups")
    if layout:
        values = sorted(r[0] for r in df.select(layout).filter(F.col(layout).isNotNull()).distinct().limit(MOST_LAYOUTS + 1).collect())
        if len(values) > MOST_LAYOUTS:
            raise ValueError(f"more than {MOST_LAYOUTS} values of {layout}")
        groups["layout"] = [f"__l{i}" for i in range(len(values))]
        df = df.withColumns({f"__l{i}": F.when(F.col(layout) == v, 1.0).otherwise(0.0) for i, v in enumerate(values)})
    cols = [c for g in groups.values() for c in g]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in cols), *(F.col(t).cast("double").alias(f"__t{i}") for i, t in enumerate(targets)), _hash(seed, key).alias("__h")).dropna(subset=cols)
    pdf = rows.orderBy("__h").limit(sample).withColumn("__held", unit(F.col("__h"), 7) < HELD).drop("__h").toPandas()  # bounded by sample
    data = spark.sparkContext.broadcast({"x": pdf[cols].to_numpy(float), "y": pdf[[f"__t{i}" for i in range(len(targets))]].to_numpy(float), "held": pdf["__held"].to_numpy(bool)})
    names, places = list(groups), {g: [cols.index(c) for c in own] for g, own in groups.items()}
    subsets = [c for m in range(len(names) + 1) for c in combinations(range(len(names)), m)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = data.value
        for b in batches:
            out = []
            for i, k in zip(b["target"], b["subset"], strict=True):
                y = d["y"][:, i]
                ok = ~np.isnan(y)
                at = [p for g in subsets[k] for p in places[names[g]]]
                r2 = boosting.held_out_r2(d["x"][ok][:, at], y[ok], d["held"][ok]) if ok.sum() >= LEAST and d["held"][ok].any() else None
                out.append((i, k, r2))
            yield pd.DataFrame(out, columns=["target", "subset", "r2"])

    tasks = [(i, k) for i in range(len(targets)) for k in range(len(subsets))]
    todo = spark.createDataFrame(tasks, "target int, subset int").repartition(len(tasks), "target", "subset")
    found = {(r.target, r.subset): r.r2 for r in todo.mapInPandas(run, "target int, subset int, r2 double").collect()}
    at, k, out = {frozenset(c): i for i, c in enumerate(subsets)}, len(names), []
    for i, t in enumerate(targets):
        if found[i, 0] is None:
            continue
        r2 = lambda c: found[i, at[frozenset(c)]] if len(c) else 0.0  # noqa: E731, B023
        for g in range(k):
            rest = [x for x in range(k) if x != g]
            out.append((t, names[g], sum(factorial(m) * factorial(k - m - 1) / factorial(k) * (r2((*c, g)) - r2(c)) for m in range(k) for c in combinations(rest, m))))
        out.append((t, "residual", 1 - r2(range(k))))
    return spark.createDataFrame(out, "metric string, feature string, share double")
