"""Graphs as relations: edges(graph_id, u, v) with u < v, nodes, packed rows, and what keeps a graph in the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_MIN, N_MAX, FLOOR = 1, 75, 8
#: The greatest density by size; above 30 nodes, DENSITY_REST.
DENSITY_STEPS = ((8, 1.0), (15, 0.75), (30, 0.6))
DENSITY_REST = 0.5
#: Parts of a group that are ranked apart before the group is.
PARTS = 64
#: In the order in which they are looked for; already_in_manifest comes before all.
REASONS = ("out_of_size", "no_edges", "disconnected", "over_density_cap")


def cooccurrence(df: DataFrame, graph: str, basket: str, item: str) -> DataFrame:
    """edges(graph_id, u, v): pairs of different items that share a basket. A basket is one array, so its pairs
    need no self-join; pairs are combined before and after the one shuffle on (graph_id, u, v)."""
    baskets = df.groupBy(graph, basket).agg(F.collect_set(item).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    return baskets.select(F.col(graph).alias("graph_id"), F.explode(pairs).alias("e")).select("graph_id", "e.u", "e.v").distinct()


def canonical_edges(df: DataFrame, graph: str, a: str, b: str) -> DataFrame:
    """edges of a directed multigraph with labels: loops and null ends out, parallel and opposite edges merged,
    labels numbered from 0 in the order of their text within each graph (of all its labels, also lonely ones)."""
    x, y = F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")
    raw = df.select(F.col(graph).alias("graph_id"), x, y).filter("x IS NOT NULL AND y IS NOT NULL").distinct()
    labels = raw.groupBy("graph_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("x", "y"))))).alias("names"))
    number = lambda c: (F.array_position("names", F.col(c)) - 1).cast("long")
    ends = raw.filter("x <> y").join(labels, "graph_id").select("graph_id", number("x").alias("p"), number("y").alias("q"))
    return ends.select("graph_id", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, node, deg)."""
    return edges.select("graph_id", F.explode(F.array("u", "v")).alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("deg"))


def size_density(edges: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, n_edges, density): density is 2m / (n (n - 1)), 0 for n < 2."""
    sizes = degrees(edges).groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.expr("sum(deg) div 2").alias("n_edges"))
    return sizes.withColumn("density", density(F.col("n_nodes"), F.col("n_edges")))


def density(n: Column, m: Column) -> Column:
    return F.when(n >= 2, 2.0 * m / (n * (n - 1))).otherwise(F.lit(0.0))


def density_cap(n: Column) -> Column:
    """The greatest density a graph of n nodes may have."""
    out = None
    for size, cap in DENSITY_STEPS:
        out = F.when(n <= size, F.lit(cap)) if out is None else out.when(n <= size, F.lit(cap))
    return out.otherwise(F.lit(DENSITY_REST))


def reject_reason(n: Column, m: Column, connected: Column, n_min: Column | int = FLOOR, n_max: Column | int = N_MAX, cap: Column | None = None) -> Column:
    """The first reason to leave a graph out, null if it stays: size (inclusive bounds), edges, connection, density."""
    over = density(n, m) > (density_cap(n) if cap is None else cap)
    return F.when(~n.between(n_min, n_max), F.lit("out_of_size")).when(m == 0, F.lit("no_edges")).when(~connected, F.lit("disconnected")).when(over, F.lit("over_density_cap"))


def size_floor(category: Column, drawings_min: int = N_MIN) -> Column:
    """The least size by cohort."""
    return F.when(category.isin("real_world", "benchmark"), F.lit(FLOOR)).otherwise(F.lit(drawings_min))


def first_accepted(df: DataFrame, by: list[str], order: list[Column], cap: Column | int) -> DataFrame:
    """The first cap rows of each group in order; a cap of 0 or null keeps all. Give only rows that passed every filter.

    A number lets every task keep no more than that of a group before the shuffle. With a column, rows are first ranked within
    parts of a group, so that no task orders a whole one.
    """
    from pyspark.sql import Window

    limit = cap if isinstance(cap, Column) else F.lit(cap)
    if isinstance(cap, int) and cap > 0:  # a literal bound lets each task keep no more than cap rows of a group
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= cap).drop("__n")
    if isinstance(cap, int):
        return df
    marked = df.withColumns({"__cap": F.coalesce(limit, F.lit(0)), "__part": F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))})
    ranked = marked.filter("__cap > 0").withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))).filter("__n <= __cap")
    ranked = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n <= __cap")
    return marked.filter("__cap = 0").drop("__cap", "__part").unionByName(ranked.drop("__cap", "__part", "__n"))


def pack(edges: DataFrame) -> DataFrame:
    """(graph_id, n, us, vs): one row for each graph, nodes numbered from 0 in order, edges in order."""
    rows = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("e"))
    rows = rows.withColumn("names", F.array_sort(F.array_distinct(F.concat("e.u", "e.v"))))
    at = lambda c: F.transform(F.col(c), lambda x: (F.array_position("names", x) - 1).cast("int"))
    return rows.select("graph_id", F.size("names").alias("n"), at("e.u").alias("us"), at("e.v").alias("vs"))


def unpack(packed: DataFrame) -> DataFrame:
    """edges of packed rows."""
    return packed.select("graph_id", F.explode(F.arrays_zip("us", "vs")).alias("e")).select("graph_id", F.col("e.us").cast("long").alias("u"), F.col("e.vs").cast("long").alias("v"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over the shuffle partitions, or three for each core if these are more. Rows that are small but dear to work on would
    else be coalesced by their bytes, and a core that meets the larger graphs would end last."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def per_graph(packed: DataFrame, kernel: Callable[..., dict], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """kernel(n, us, vs, *extra columns) for every packed row, in Arrow batches; its dict makes the columns of
    schema behind graph_id. A kernel that raises gives nulls."""
    out = T.StructType([packed.schema["graph_id"], *T._parse_datatype_string(schema).fields])
    names = out.names[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    got = kernel(int(r.n), np.asarray(r.us, np.int64), np.asarray(r.vs, np.int64), *(getattr(r, c) for c in extra))
                except Exception:  # noqa: BLE001
                    got = {}
                rows.append((r.graph_id, *(got.get(c) for c in names)))
            yield pd.DataFrame(rows, columns=out.names).astype({"graph_id": b["graph_id"].dtype})

    return spread(packed.select("graph_id", "n", "us", "vs", *extra), "graph_id").mapInPandas(run, out)
