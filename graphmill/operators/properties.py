"""Structural invariants of every graph: native where columns can say it, one kernel pass for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import corpus

#: The 24 invariants in their contractual order.
NAMES = [
    "n_nodes", "n_edges", "density", "is_bipartite", "is_planar", "is_tree", "is_forest", "is_regular", "is_eulerian", "min_degree", "max_degree", "mean_degree", "degree_std",
    "diameter", "radius", "avg_shortest_path_length", "n_triangles", "average_clustering", "transitivity", "degree_assortativity", "n_biconnected_components", "degeneracy",
    "crossing_number_lb_euler", "crossing_number_lb_bipartite",
]


def euler_bound(n: Column, m: Column) -> Column:
    """Edges beyond those of a plane graph of n nodes; 0 for n < 3."""
    return F.when(n < 3, F.lit(0)).otherwise(F.greatest(F.lit(0), m - (3 * n - 6)))


def bipartite_bound(n: Column, m: Column, bipartite: Column) -> Column:
    """As euler_bound for bipartite graphs; null for others."""
    return F.when(bipartite, F.when(n < 3, F.lit(0)).otherwise(F.greatest(F.lit(0), m - (2 * n - 4))).cast("double"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, n_edges, min_degree, max_degree, mean_degree, degree_std (population), all_even)."""
    return corpus.degrees(edges).groupBy("graph_id").agg(
        F.count("*").alias("n_nodes"), F.expr("sum(deg) div 2").alias("n_edges"), F.min("deg").alias("min_degree"), F.max("deg").alias("max_degree"),
        F.avg("deg").alias("mean_degree"), F.stddev_pop("deg").alias("degree_std"), F.bool_and(F.col("deg") % 2 == 0).alias("all_even"),
    )


def neighbour_maps(edges: DataFrame) -> DataFrame:
    """(graph_id, near): one row for each graph, near the neighbours of each node. What is counted along edges can then be
    counted within the row, without a join; a row is as large as its graph."""
    both = edges.select("graph_id", F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e"))
    lists = both.groupBy("graph_id", F.col("e.a").alias("node")).agg(F.collect_list("e.b").alias("near"))
    return lists.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "near"))).alias("near"))


def node_triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, nodes): an array of (node, deg, tri) with the number of triangles at each node: what the neighbour arrays
    of both ends of its edges share, halved."""
    shared = lambda e: F.aggregate(e["value"], F.lit(0).cast("long"), lambda s, v: s + F.size(F.array_intersect(e["value"], F.element_at("near", v))))
    at = lambda e: F.struct(e["key"].alias("node"), F.size(e["value"]).cast("long").alias("deg"), F.floor(shared(e) / 2).cast("long").alias("tri"))
    return neighbour_maps(edges).select("graph_id", F.transform(F.map_entries("near"), at).alias("nodes"))


def clustering(edges: DataFrame) -> DataFrame:
    """(graph_id, n_triangles, average_clustering, transitivity)."""
    total = lambda f, zero: F.aggregate("nodes", F.lit(0).cast(zero), lambda s, x: s + f(x).cast(zero))
    wedges = lambda x: x["deg"] * (x["deg"] - 1)
    local = lambda x: F.when(x["deg"] > 1, 2.0 * x["tri"] / wedges(x)).otherwise(F.lit(0.0))
    sums = node_triangles(edges).select("graph_id", F.floor(total(lambda x: x["tri"], "long") / 3).cast("long").alias("n_triangles"), (total(local, "double") / F.size("nodes")).alias("average_clustering"), (total(wedges, "long") / 2).alias("triads"))
    return sums.select("graph_id", "n_triangles", "average_clustering", F.when(F.col("triads") > 0, 3.0 * F.col("n_triangles") / F.col("triads")).otherwise(F.lit(0.0)).alias("transitivity"))


def assortativity(edges: DataFrame) -> DataFrame:
    """(graph_id, degree_assortativity): Pearson correlation of the degrees at both ends, each edge in both
    directions; null if all degrees at ends are equal."""
    d = lambda x: F.size(x).cast("double")
    # over directed edges: n of them, s the sum and q the sum of squares of the degrees at one end, p of the products
    around = lambda e: F.aggregate(e["value"], F.lit(0.0), lambda s, v: s + d(F.element_at("near", v)))
    term = lambda e: F.struct(d(e["value"]).alias("n"), (d(e["value"]) ** 2).alias("s"), (d(e["value"]) ** 3).alias("q"), (d(e["value"]) * around(e)).alias("p"))
    terms = neighbour_maps(edges).select("graph_id", F.transform(F.map_entries("near"), term).alias("t"))
    total = lambda c: F.aggregate(F.col(f"t.{c}"), F.lit(0.0), lambda s, x: s + x)
    sums = terms.select("graph_id", *(total(c).alias(c) for c in "nsqp"))
    var = F.col("n") * F.col("q") - F.col("s") * F.col("s")
    return sums.select("graph_id", F.when(var > 0, (F.col("n") * F.col("p") - F.col("s") * F.col("s")) / var).alias("degree_assortativity"))


def shape_kernel(n: int, us, vs) -> dict:  # noqa: ANN001
    return {"n_components": kernels.n_components(n, us, vs), "is_bipartite": kernels.is_bipartite(n, us, vs), **kernels.distance_summary(n, us, vs)}


def deep_kernel(n: int, us, vs) -> dict:  # noqa: ANN001
    return {"is_planar": kernels.is_planar(n, us, vs), "n_biconnected_components": len(kernels.blocks(n, us, vs)), "degeneracy": kernels.degeneracy(n, us, vs)}


SHAPE = "n_components int, is_bipartite boolean, diameter double, radius double, avg_shortest_path_length double"
DEEP = "is_planar boolean, n_biconnected_components int, degeneracy int"


def manifest_row(n: int, us, vs) -> dict:  # noqa: ANN001
    """All 24 invariants of one graph; what is undefined is None."""
    import numpy as np

    m = len(us)
    a = kernels.adjacency(n, us, vs).astype(np.int64)
    deg = a.sum(axis=1)
    got = shape_kernel(n, us, vs) | deep_kernel(n, us, vs)
    parts = got.pop("n_components")
    tri = np.einsum("ij,ji->i", a @ a, a) // 2 if n else deg
    triads = float((deg * (deg - 1)).sum()) / 2
    pairs = np.where(deg > 1, deg * (deg - 1), 1)
    x, y = np.concatenate((deg[us], deg[vs])).astype(float), np.concatenate((deg[vs], deg[us])).astype(float)
    var = len(x) * (x * x).sum() - x.sum() ** 2 if m else 0.0
    bip = got["is_bipartite"]
    return got | {
        "n_nodes": n, "n_edges": m, "density": 2.0 * m / (n * (n - 1)) if n > 1 else 0.0, "is_tree": parts == 1 and m == n - 1, "is_forest": m == n - parts,
        "is_regular": bool(n) and int(deg.min()) == int(deg.max()), "is_eulerian": parts == 1 and bool((deg % 2 == 0).all()), "min_degree": int(deg.min()) if n else None, "max_degree": int(deg.max()) if n else None,
        "mean_degree": float(deg.mean()) if n else None, "degree_std": float(deg.std()) if n else None, "n_triangles": int(tri.sum()) // 3,
        "average_clustering": float((2.0 * tri / pairs)[deg > 1].sum() / n) if n else None, "transitivity": float(tri.sum()) / triads if triads else 0.0,
        "degree_assortativity": float((len(x) * (x * y).sum() - x.sum() ** 2) / var) if var > 0 else None,
        "crossing_number_lb_euler": 0 if n < 3 else max(0, m - (3 * n - 6)), "crossing_number_lb_bipartite": None if not bip else 0.0 if n < 3 else float(max(0, m - (2 * n - 4))),
    }


MANIFEST = (
    "n_nodes int, n_edges int, density double, is_bipartite boolean, is_planar boolean, is_tree boolean, is_forest boolean, is_regular boolean, is_eulerian boolean, min_degree int, max_degree int, mean_degree double, degree_std double, "
    "diameter double, radius double, avg_shortest_path_length double, n_triangles long, average_clustering double, transitivity double, degree_assortativity double, n_biconnected_components int, degeneracy int, "
    "crossing_number_lb_euler int, crossing_number_lb_bipartite double"
)


def manifest24(packed: DataFrame) -> DataFrame:
    """graph_id and the 24 invariants of packed graphs, in one pass."""
    return corpus.per_graph(packed, manifest_row, MANIFEST)


#: What a timed row measures: each kernel, and the rest of the row.
TIMED = {
    "n_components": kernels.n_components, "is_bipartite": kernels.is_bipartite, "distances": kernels.distance_summary, "is_planar": kernels.is_planar,
    "n_biconnected_components": kernels.blocks, "degeneracy": kernels.degeneracy, "all": manifest_row,
}


def _timed(n: int, us, vs) -> dict:  # noqa: ANN001
    from time import perf_counter

    out = {}
    for name, f in TIMED.items():
        began = perf_counter()
        try:
            f(n, us, vs)
        finally:
            out[name] = perf_counter() - began
    return {"n_nodes": n, "n_edges": len(us), "seconds": out}


def timings(packed: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, n_edges, property, seconds): how long each kernel took for each graph."""
    df = corpus.per_graph(packed, _timed, "n_nodes int, n_edges int, seconds map<string,double>")
    return df.select("graph_id", "n_nodes", "n_edges", F.explode("seconds").alias("property", "seconds"))
