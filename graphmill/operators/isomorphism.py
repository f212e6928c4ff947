"""Classes of isomorphic graphs: equal Weisfeiler-Lehman hashes, then an exact comparison with a representative."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..scale import skew_join
from ..session import materialize
from .corpus import per_graph, spread


def _label(n: int, us: np.ndarray, vs: np.ndarray) -> dict:
    return {"wl": kernels.wl_hash(n, us, vs)}


def isomorphism_classes(packed: DataFrame) -> DataFrame:
    """(graph_id, class_id): class_id is the smallest graph_id of those isomorphic to the graph.

    packed has one row for each graph. In every bucket of equal size and hash, all graphs are compared with the
    smallest one, never with each other; those that differ from it go into another round. Rounds are as many as the
    most classes that share a hash.
    """
    rest = materialize(packed.select("graph_id", "n", "us", "vs").join(per_graph(packed, _label, "wl string"), "graph_id").withColumn("bucket", F.concat_ws("|", "n", F.size("us"), "wl")).drop("wl"))
    done: list[DataFrame] = []
    schema = T.StructType([rest.schema["graph_id"], T.StructField("rep", rest.schema["graph_id"].dataType), T.StructField("same", T.BooleanType())])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = []
            for r in b.itertuples(index=False):
                x, y = ((int(r.n), np.asarray(u, np.int64), np.asarray(v, np.int64)) for u, v in ((r.us, r.vs), (r.rep_us, r.rep_vs)))
                same.append(r.graph_id == r.rep or np.array_equal(x[1], y[1]) and np.array_equal(x[2], y[2]) or kernels.is_isomorphic(x, y))
            yield pd.DataFrame({"graph_id": b["graph_id"], "rep": b["rep"], "same": same})

    while rest.limit(1).count():
        first = rest.groupBy("bucket").agg(F.min_by(F.struct(F.col("graph_id").alias("rep"), F.col("us").alias("rep_us"), F.col("vs").alias("rep_vs")), "graph_id").alias("f")).select("bucket", "f.*")
        tested = materialize(spread(skew_join(rest, first, ["bucket"]).select("graph_id", "n", "us", "vs", "rep", "rep_us", "rep_vs"), "graph_id").mapInPandas(compare, schema))
        done.append(tested.filter("same").select("graph_id", F.col("rep").alias("class_id")))
        rest = materialize(rest.join(tested.filter("NOT same").select("graph_id"), "graph_id", "left_semi"))
    if not done:
        return packed.select("graph_id", F.col("graph_id").alias("class_id")).limit(0)
    return reduce(DataFrame.unionByName, done)
