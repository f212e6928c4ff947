"""Generated cohorts: random draws that are pure functions of (root, number), the calibration catalogue, all small graphs."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import generators, kernels
from ..seeds import seed
from ..session import materialize
from .corpus import DENSITY_REST, DENSITY_STEPS, FLOOR, N_MAX

DRAWN = T.StructType([T.StructField("draw", T.LongType()), T.StructField("generator", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("us", T.ArrayType(T.IntegerType())), T.StructField("vs", T.ArrayType(T.IntegerType())), T.StructField("valid", T.BooleanType())])

#: Draws in a row without a new graph at which drawing ends: the reference's 50 retries of a graph, 100 graphs in a row.
FRUITLESS = 50 * 100


def is_valid(n: int, us: np.ndarray, vs: np.ndarray, n_min: int, n_max: int) -> bool:
    """The corpus filters on one graph."""
    m = len(us)
    cap = next((c for size, c in DENSITY_STEPS if n <= size), DENSITY_REST)
    return m > 0 and n_min <= n <= n_max and kernels.n_components(n, us, vs) == 1 and 2 * m / (n * (n - 1)) <= cap


def draw(root: int, number: int, n_min: int, n_max: int, families: list[str] | None = None) -> tuple[str, int, tuple]:
    """Draw number: a uniform size, then a family among those that have it, by weight, then the graph."""
    r = np.random.default_rng(seed(root, "draw", number))
    n = int(r.integers(n_min, n_max + 1))
    fit = {k: f for k, f in generators.FAMILIES.items() if f.least <= n and (families is None or k in families)}
    if not fit:
        return "", 0, (n, np.empty(0, np.int64), np.empty(0, np.int64))
    w = np.array([f.weight for f in fit.values()])
    name = list(fit)[int(np.searchsorted(np.cumsum(w / w.sum()), r.random()).clip(0, len(fit) - 1))]
    own = seed(root, "graph", number) % 2**31
    return name, own, fit[name].make(np.random.default_rng(own), n)


def draws(spark: SparkSession, count: int, root: int = 1, n_min: int = FLOOR, n_max: int = N_MAX, families: list[str] | None = None, tasks: int | None = None, start: int = 0) -> DataFrame:
    """(draw, generator, seed, n, us, vs, valid) for draws start .. count - 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["id"].tolist():
                name, own, (n, us, vs) = draw(root, k, n_min, n_max, families)
                rows.append((k, name, own, n, us.astype(np.int32), vs.astype(np.int32), bool(name) and is_valid(n, us, vs, n_min, n_max)))
            yield pd.DataFrame(rows, columns=DRAWN.names)

    return spark.range(start, count, 1, tasks or spark.sparkContext.defaultParallelism * 2).mapInPandas(run, DRAWN)


def generated(spark: SparkSession, count: int, root: int = 1, n_min: int = FLOOR, n_max: int = N_MAX, families: list[str] | None = None, oversample: float = 2.5) -> DataFrame:
    """(graph_id, generator, seed, n, us, vs): the first count valid draws with different ids, by number. Neither
    partitions nor an earlier run change them. oversample * count numbers are drawn, then further blocks until there are
    count graphs; if FRUITLESS draws in a row give no new one, fewer come out, with a warning."""
    from pyspark.sql import Window

    name = F.format_string("%s_n%03d_m%04d_s%d.graphml", "generator", "n", F.size("us"), "seed")
    found, have, start, end, idle = None, 0, 0, int(count * oversample) + 20, 0
    while have < count and idle < FRUITLESS:
        block = materialize(draws(spark, end, root, n_min, n_max, families, start=start).filter("valid").withColumn("graph_id", name))
        found, before = block if found is None else found.unionByName(block), have
        have = found.select("graph_id").distinct().count()
        idle = idle + end - start if have == before else 0
        lacking = int((count - have) * 1.2 * end / have) if have else FRUITLESS
        start, end = end, end + min(max(lacking, 200), max(4 * end, FRUITLESS))
    if found is None:
        found = draws(spark, 0, root, n_min, n_max, families).withColumn("graph_id", name)
    if have < count:
        warnings.warn(f"{have} of {count} graphs generated: the last {idle} of {start} draws gave no new one", stacklevel=2)
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("graph_id").orderBy("draw"))).filter("r = 1").drop("r")
    return first.orderBy("draw").limit(count).select("graph_id", "generator", "seed", "n", "us", "vs")


def family_yield(spark: SparkSession, count: int, root: int = 1, n_min: int = FLOOR, n_max: int = N_MAX) -> DataFrame:
    """By family: tried, succeeded, yield, share of all that succeeded."""
    from .analysis import yields

    return yields(draws(spark, count, root, n_min, n_max), "generator", F.col("valid"))


def _packed(spark: SparkSession, named: list[tuple[str, generators.Graph]], generator: str) -> DataFrame:
    rows = [(k, generator, 0, n, us.tolist(), vs.tolist()) for k, (n, us, vs) in named]
    return spark.createDataFrame(rows, "graph_id string, generator string, seed long, n int, us array<int>, vs array<int>")


def calibration(spark: SparkSession) -> DataFrame:
    """The 84 named graphs of the calibration catalogue."""
    return _packed(spark, [(f"calibration_{k}_n{g[0]:03d}_m{len(g[1]):04d}.graphml", g) for k, g in generators.calibration()], "calibration")


def exhaustive_small(spark: SparkSession, n: int = 7) -> DataFrame:
    """One of each connected graph of at most n nodes: 996 for n = 7."""
    return _packed(spark, [(f"small_n{g[0]:03d}_m{len(g[1]):04d}_{i:04d}.graphml", g) for i, g in enumerate(generators.connected_up_to(n))], "exhaustive_small")
