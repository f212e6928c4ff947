"""Groups of records linked directly or over others: seed-tree pruning.

Every round, each vertex tells its neighbours the smallest name around it. A vertex that is nobody's smallest
leaves the graph and hangs below its own smallest name in the propagation forest; the links among the names
that met at it stay in the graph. The graph shrinks to nothing in about logarithmically many rounds, even for
long chains. Then the roots' names flow down the forest, the last leavers first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import skew_join
from ..session import materialize, release


def links(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links (u, v), u < v, of df's rows; null ends and rows with the same name twice link nothing."""
    x, y = F.col(a).alias("x"), F.col(b).alias("y")
    return df.select(x, y).filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def connected_groups(df: DataFrame, a: str, b: str) -> DataFrame:
    """(group_id, id) for every name that df links to another, in columns a and b.

    group_id is the smallest name of all that are linked directly or indirectly; names compare by their bytes.
    Links may repeat, stand in both directions or have a null end (which links nothing). No links, no rows.
    """
    one = links(df, a, b)
    graph = materialize(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    kind = graph.schema["u"].dataType
    forest: list[DataFrame] = []
    kept: list[DataFrame] = []
    n = graph.count()
    while n:
        smallest = graph.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        told = skew_join(graph, smallest, ["u"], n=n).select(F.col("v").alias("u"), "m").unionByName(smallest).distinct()
        told = materialize(told)
        own = told.groupBy("u").agg(F.min("m").alias("p"), F.max(F.col("m") == F.col("u")).alias("stays"), F.count("*").alias("names"))
        own = materialize(own)
        kept.append(own)
        forest.append(own.filter("NOT stays").select("u", "p"))
        met = skew_join(told, own.filter("names > 1").select("u", "p"), ["u"]).filter("m <> p").select(F.col("m").alias("u"), F.col("p").alias("v")).distinct()
        both = materialize(met.unionByName(met.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        release(graph, told)
        graph, n = both, both.count()
    release(graph)
    if not forest:
        return df.sparkSession.createDataFrame([], "group_id string, id string").select(F.col("group_id").cast(kind), F.col("id").cast(kind))
    named: list[DataFrame] = []
    for leavers in reversed(forest):
        if not named:
            named.append(leavers.select("u", F.col("p").alias("g")))
            continue
        above = reduce(DataFrame.unionByName, named).withColumnRenamed("u", "p")
        named.append(materialize(skew_join(leavers, above, ["p"], "left").select("u", F.coalesce("g", "p").alias("g"))))
    out = reduce(DataFrame.unionByName, named)
    roots = out.select("g").distinct().select(F.col("g").alias("u"), "g")
    out = materialize(out.unionByName(roots).select(F.col("g").alias("group_id"), F.col("u").alias("id")))
    release(*kept, *named)
    return out
