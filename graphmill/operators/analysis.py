"""Relational statistics on drawings and graphs. Give numbers with NaN as null (functions.text.number): null is skipped."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..scale import exact_percentiles, in_order, ordered_counts, skew_join, small_or_not
from ..session import materialize
from .tables import edges_of, quantile_bin

#: Scores that make the quality of a drawing (the Gabriel ratio isn't one), and those of its empirical variant.
QUALITY = [
    "angular_resolution", "aspect_ratio", "crossing_angle", "edge_crossings", "edge_length_deviation", "edge_orthogonality", "kruskal_stress", "neighbourhood_preservation",
    "node_edge_occlusion", "node_resolution", "node_uniformity",
]
EMPIRICAL = ["node_edge_occlusion", "edge_crossings", "angular_resolution"]
#: Invariants that are correlated with scores.
PROPERTIES = [
    "n_nodes", "n_edges", "density", "min_degree", "max_degree", "mean_degree", "degree_std", "diameter", "radius", "avg_shortest_path_length", "n_triangles", "average_clustering",
    "transitivity", "degree_assortativity", "n_biconnected_components", "degeneracy", "crossing_number_lb_euler",
]
LEAST_PAIRS, LEAST_IN_BIN, LEAST_ROWS, LOW_N = 30, 10, 100, 1000


def mean_of(names: list[str]) -> Column:
    """The mean of the columns that aren't null; null if all are."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in names))
    n = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in names))
    return F.when(n > 0, total / n)


def union_layouts(frames: dict[str, DataFrame]) -> DataFrame:
    """Tables of single layouts, one below the other, with the layout's name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("layout", F.lit(k)) for k, df in frames.items()))


def envelope(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """By graph: n_drawings, and min, max, mean and range of each metric."""
    aggs = [x for m in metrics for x in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.avg(m).alias(f"{m}_mean"), (F.max(m) - F.min(m)).alias(f"{m}_range"))]
    return df.groupBy(by).agg(F.count("*").alias("n_drawings"), *aggs)


def sequential_variance(df: DataFrame, metrics: list[str], factors: list[str]) -> DataFrame:
    """(metric, factor, share): the share of each metric's sum of squares that group means of the factors take, one after
    another, each from what the one before left; the last row, "residual", is the rest. Null for a constant metric.

    Group means come from aggregates that are joined back, all metrics in one go, so a factor value with many rows is
    combined within the tasks first.
    """
    cols = [f"r{i}" for i in range(len(metrics))]
    mean = df.agg(*(F.avg(m).alias(f"m{i}") for i, m in enumerate(metrics)))
    cur = df.crossJoin(F.broadcast(mean)).select(*factors, *((F.col(m) - F.col(f"m{i}")).alias(c) for i, (m, c) in enumerate(zip(metrics, cols, strict=True))))
    sums = [cur.agg(*(F.sum(F.col(c) ** 2).alias(c) for c in cols)).withColumn("step", F.lit(0))]
    for k, f in enumerate(factors, 1):
        cur = materialize(cur)  # read by the means, the join and the sums
        means = cur.groupBy(f).agg(*(F.avg(c).alias(f"g_{c}") for c in cols))
        cur = skew_join(cur.filter(F.col(f).isNotNull()), means, [f]).select(*factors, *((F.col(c) - F.col(f"g_{c}")).alias(c) for c in cols))
        sums.append(cur.agg(*(F.sum(F.col(c) ** 2).alias(c) for c in cols)).withColumn("step", F.lit(k)))
    s = reduce(DataFrame.unionByName, sums)
    long = s.select("step", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("ss")) for m, c in zip(metrics, cols, strict=True)))).alias("x")).select("step", "x.metric", "x.ss")
    per = long.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("step", F.coalesce("ss", F.lit(0.0))))).alias("ss"))
    at = lambda k: F.element_at("ss", F.lit(k))
    shares = [F.struct(F.lit(f).alias("factor"), F.when(at(0) > 0, (at(k) - at(k + 1)) / at(0)).alias("share")) for k, f in enumerate(factors)]
    shares.append(F.struct(F.lit("residual").alias("factor"), F.when(at(0) > 0, at(len(factors)) / at(0)).alias("share")))
    return per.select("metric", F.explode(F.array(*shares)).alias("x")).select("metric", "x.factor", "x.share")


def _pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(p, vx, vy) of the rows in which both columns of pair number p have a value; a table, as it is read several times."""
    one = lambda p, x, y: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.lit(p).alias("p"), F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")))
    return materialize(df.select(F.explode(F.array_compact(F.array(*(one(p, x, y) for p, (x, y) in enumerate(pairs))))).alias("t")).select("t.*"))


def _named(pairs: list[tuple[str, str]]) -> list[Column]:
    return [F.element_at(F.array(*(F.lit(k[i]) for k in pairs)), F.col("p") + 1).alias(name) for i, name in enumerate("xy")]


def spearman(df: DataFrame, xs: list[str], ys: list[str], key: str | None = None) -> DataFrame:
    """(x, y, n, rho): rank correlation of each column of xs with each of ys over the rows in which both have a value;
    pairs of fewer than LEAST_PAIRS rows, or without variation, are left out. With key, pairs (x, y) need x < y.

    Only x's ranks meet the rows (their join has one row for a value, so AQE may split a hot one); y's are needed for its
    different values alone, of which each brings the sum of its rows' x ranks. Ties share their average rank.
    """
    pairs = [(x, y) for x in xs for y in ys if not key or x < y]
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, n long, rho double")
    long = _pairs(df, pairs)
    rank = F.col("before") + (F.col("n") + 1) / 2
    of_x = ordered_counts(long, ["p"], "vx").withColumn("r", rank)
    met = long.join(of_x.select("p", "vx", "r"), ["p", "vx"])
    by_y = materialize(met.groupBy("p", "vy").agg(F.count("*").alias("n"), F.sum("r").alias("rx"), F.sum(F.col("r") ** 2).alias("rxx")))
    of_y = in_order(by_y, ["p"], "vy").withColumn("r", rank)
    sums = of_y.groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("rx")).alias("xy"), F.sum("rxx").alias("xx"), F.sum(F.col("n") * F.col("r") ** 2).alias("yy"))
    mid = F.col("n") * ((F.col("n") + 1) / 2) ** 2  # n times the squared mean rank
    var = (F.col("xx") - mid) * (F.col("yy") - mid)
    rho = F.when((F.col("xx") - mid > 1e-6) & (F.col("yy") - mid > 1e-6), (F.col("xy") - mid) / F.sqrt(var))
    return sums.filter(F.col("n") >= LEAST_PAIRS).select(*_named(pairs), "n", rho.alias("rho")).filter("rho IS NOT NULL")


def binned(df: DataFrame, xs: list[str], ys: list[str], bins: list[int], quantiles: bool) -> DataFrame:
    """For each x, y and number of bins: bins of x (equal counts or equal widths, right-closed) with n, quartiles of x and min,
    median, max of y, beside the range of y over all rows; bins of fewer than LEAST_IN_BIN rows are left out, and pairs
    of fewer than LEAST_ROWS rows, or whose x doesn't vary.

    Percentiles are exact and come from counts in order (scale.exact_percentiles), so no task holds a pair or a bin.
    """
    pairs = [(x, y) for x in xs for y in ys]
    long = _pairs(df, pairs)
    span = long.groupBy("p").agg(F.min("vx").alias("lo"), F.max("vx").alias("hi"), F.count("*").alias("all"), F.min("vy").alias("y_low"), F.max("vy").alias("y_high")).filter((F.col("all") >= LEAST_ROWS) & (F.col("hi") > F.col("lo")))
    if quantiles:
        every = sorted({i / b for b in bins for i in range(b + 1)})
        ways = [F.struct(F.lit(b).alias("bins"), F.array(*(F.lit(every.index(i / b) + 1) for i in range(b + 1))).alias("at")) for b in bins]
        found = exact_percentiles(long, ["p"], "vx", every).drop("rows")
        edges = found.withColumn("w", F.explode(F.array(*ways))).select("p", "w.bins", edges_of(F.transform("w.at", lambda a: F.element_at("q", a))).alias("e"))
        span = span.join(edges, "p")
        number = quantile_bin(F.col("vx"), F.col("e"))
    else:
        span = span.withColumn("bins", F.explode(F.array(*map(F.lit, bins))))
        number = F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.ceil(F.round((F.col("vx") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"), 9)) - 1))
    span = materialize(span)  # a row for each pair and number of bins
    marked = long.join(small_or_not(span), "p").withColumn("bin", number.cast("int")).filter("bin IS NOT NULL")
    two = F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("vx").alias("v")), F.struct(F.lit(1).alias("of"), F.col("vy").alias("v"))))
    by = ["p", "bins", "bin"]
    found = exact_percentiles(marked.select(*by, two.alias("t")).select(*by, "t.of", "t.v"), [*by, "of"], "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    of = lambda c, i: F.max(F.when(F.col("of") == c, F.element_at("q", i)))
    out = found.groupBy(*by).agg(F.max("rows").alias("n"), of(0, 2).alias("x_p25"), of(0, 3).alias("x_median"), of(0, 4).alias("x_p75"), of(1, 1).alias("y_min"), of(1, 3).alias("y_median"), of(1, 5).alias("y_max"))
    out = out.filter(F.col("n") >= LEAST_IN_BIN).withColumn("low_n", F.col("n") < LOW_N).join(small_or_not(span.select("p", "bins", "y_low", "y_high")), ["p", "bins"])
    return out.select(*_named(pairs), *(c for c in out.columns if c != "p"))


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with place, from 1, in order. For the few rows of a chart or table: one task numbers them."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def custom_order(c: Column, names: list[str]) -> Column:
    """The place of c in names; behind all for others and null."""
    at = F.array_position(F.array(*map(F.lit, names)), c)
    return F.when(at > 0, at).otherwise(F.lit(len(names) + 1))


def prefix_source(ids: DataFrame, sources: DataFrame, column: str = "graph_id") -> DataFrame:
    """ids with source: the longest of sources whose name (with / as _) and an underscore begin the id, else 'unknown'.

    Every beginning of an id that ends before an underscore is looked up, an equi-join instead of comparing all with all.
    """
    names = sources.select(F.col("source").alias("__source"), F.translate("source", "/", "_").alias("__p")).filter("__p IS NOT NULL").groupBy("__p").agg(F.min("__source").alias("__source"))
    parts = F.split(column, "_")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    distinct = ids.select(column).filter(F.col(column).isNotNull()).distinct()
    tried = distinct.filter(F.size(parts) > 1).select(column, F.explode(starts).alias("__p")).join(names, "__p")
    best = tried.groupBy(column).agg(F.max_by("__source", F.length("__p")).alias("source"))
    return ids.drop("source").join(best, column, "left").withColumn("source", F.coalesce("source", F.lit("unknown")))


def yields(df: DataFrame, by: str, ok: Column) -> DataFrame:
    """By group: tried, succeeded, their ratio in percent, and the group's share of all that succeeded."""
    out = df.groupBy(by).agg(F.count("*").alias("tried"), F.sum(ok.cast("long")).alias("succeeded"))
    total = out.agg(F.sum("succeeded").alias("__all"))
    out = out.crossJoin(F.broadcast(total))
    return out.select(by, "tried", "succeeded", (100.0 * F.col("succeeded") / F.col("tried")).alias("yield_pct"), F.when(F.col("__all") > 0, F.col("succeeded") / F.col("__all")).alias("share"))


def clusters(rho: DataFrame, names: list[str], threshold: float) -> list[tuple[str, int, int]]:
    """(name, cluster, place in leaf order) by average linkage on 1 - |rho|, cut where |rho| falls below threshold.

    Clusters and leaves are at most as many as names (columns of a table), so the matrix is worked on here.
    """
    at = {n: i for i, n in enumerate(names)}
    d = np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0)
    for r in rho.collect():
        if r.x in at and r.y in at and r.rho is not None and r.rho == r.rho:
            d[at[r.x], at[r.y]] = d[at[r.y], at[r.x]] = min(1.0, max(0.0, 1 - abs(r.rho)))
    cluster, order = kernels.flat_clusters(len(names), kernels.upgma(d), max(1e-9, 1 - threshold))
    return [(names[i], cluster[i], k) for k, i in enumerate(order)]


# How much an invariant is preferred as its cluster's representative, and the names of clusters of just these members.
PREFERENCE = {
    "n_edges": 2, "n_nodes": 1, "avg_shortest_path_length": 2, "diameter": 1, "radius": 0, "transitivity": 2, "average_clustering": 1, "n_triangles": 0, "mean_degree": 2, "degeneracy": 1,
    "max_degree": 2, "degree_std": 1,
}
NAMED_CLUSTERS = {
    frozenset({"n_nodes", "n_edges"}): "Size (|V|, |E|)", frozenset({"max_degree", "degree_std"}): "Degree heterogeneity",
    frozenset({"n_triangles", "average_clustering", "transitivity", "mean_degree", "degeneracy"}): "Local density / clustering",
    frozenset({"density", "radius", "diameter", "avg_shortest_path_length"}): "Density / distance", frozenset({"min_degree", "n_biconnected_components"}): "Local connectivity",
}


def representatives(found: list[tuple[str, int, int]], preferred: dict[str, int] | tuple[str, ...] = ()) -> dict[int, str]:
    """Of each cluster the member of greatest preference (given as numbers, or by order), then the first name in the alphabet."""
    weights = preferred if isinstance(preferred, dict) else {p: len(preferred) - i for i, p in enumerate(preferred)}
    clusters: dict[int, list[str]] = {}
    for name, c, _ in found:
        clusters.setdefault(c, []).append(name)
    return {c: min(members, key=lambda m: (-weights.get(m, 0), m)) for c, members in sorted(clusters.items())}


def cluster_titles(found: list[tuple[str, int, int]], preferred: dict[str, int] = PREFERENCE, titles: dict[frozenset[str], str] = NAMED_CLUSTERS) -> dict[int, str]:
    """The title of each cluster: that of its very members, else its representative."""
    members: dict[int, set[str]] = {}
    for name, c, _ in found:
        members.setdefault(c, set()).add(name)
    return {c: titles.get(frozenset(members[c]), top) for c, top in representatives(found, preferred).items()}


def with_composites(found: list[tuple[str, int, int]], names: tuple[str, ...] = ("quality", "empirical_quality")) -> list[tuple[str, int, int]]:
    """found, behind whose leaves each composite is a cluster of its own."""
    top, last = max((c for _, c, _ in found), default=0), len(found)
    return [*found, *((n, top + i, last + i - 1) for i, n in enumerate(names, 1))]


#: Values of a column that shapley_r2 takes one-hot.
MOST_LAYOUTS = 1000


def shapley_r2(df: DataFrame, target: str, groups: dict[str, list[str]], layout: str | None = None, seed: int = 7) -> list[tuple[str, float]]:
    """(group, share) of the R2 that a linear fit of target on groups of columns has, by exact Shapley values over all
    subsets of groups (at most 8), and "residual" = 1 - R2. With layout, the column's values (at most MOST_LAYOUTS, more are
    an error) make a group, one-hot.

    One pass gathers the sums of products of all columns; every subset's fit is then solved from that matrix.
    """
    from itertools import combinations
    from math import factorial

    if len(groups) + bool(layout) > 8:
        raise ValueError("at most 8 groups")
    groups = dict(groups)
    if layout:
        values = sorted(r[0] for r in df.select(layout).filter(F.col(layout).isNotNull()).distinct().limit(MOST_LAYOUTS + 1).collect())
        if len(values) > MOST_LAYOUTS:
            raise ValueError(f"more than {MOST_LAYOUTS} values of {layout}")
        names = []
        for i, v in enumerate(values):
            df = df.withColumn(f"__l{i}", F.when(F.col(layout) == v, 1.0).otherwise(0.0))
            names.append(f"__l{i}")
        groups["layout"] = names
    cols = [c for g in groups.values() for c in g]
    rows = df.select(*(F.col(c).cast("double") for c in cols), F.col(target).cast("double").alias("__y")).dropna()
    every = [*cols, "__y"]
    pairs = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
    mean = rows.agg(F.count("*"), *(F.avg(c) for c in every)).first()
    n, mu = mean[0], np.array([x or 0.0 for x in mean[1:]], float)
    if not n:
        return [(g, 0.0) for g in groups] + [("residual", 1.0)]
    sums = rows.agg(*(F.sum((F.col(every[i]) - float(mu[i])) * (F.col(every[j]) - float(mu[j]))) for i, j in pairs)).first()
    s = np.zeros((len(every), len(every)))
    for (i, j), v in zip(pairs, sums, strict=True):
        s[i, j] = s[j, i] = v
    memo: dict[frozenset[str], float] = {}

    def r2(subset: frozenset[str]) -> float:
        if subset not in memo:
            at = [every.index(c) for g in subset for c in groups[g]]
            if not at or s[-1, -1] <= 0:
                memo[subset] = 0.0
            else:
                beta = np.linalg.lstsq(s[np.ix_(at, at)], s[at, -1], rcond=1e-10)[0]
                memo[subset] = float(np.clip(beta @ s[at, -1] / s[-1, -1], 0, 1))
        return memo[subset]

    k, out = len(groups), []
    for g in groups:
        rest = [x for x in groups if x != g]
        out.append((g, sum(factorial(m) * factorial(k - m - 1) / factorial(k) * (r2(frozenset({*c, g})) - r2(frozenset(c))) for m in range(k) for c in combinations(rest, m))))
    return [*out, ("residual", 1 - r2(frozenset(groups)))]
