"""Queries that SQL cannot express: clustering, attribution, isomorphism, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, corpus, generate, isomorphism
from ..session import materialize
from ..operators.analysis import QUALITY
from .q_analysis import CLEAN, _means, clean
from .q_corpus import edges
from .q_tables import FIRST_SQL
from .registry import query


def _clusters(spark, rho, names, threshold, preferred=()):  # noqa: ANN001, ANN202
    found = analysis.clusters(rho, names, threshold)
    top, titles = analysis.representatives(found, preferred), analysis.cluster_titles(found)
    return spark.createDataFrame([(n, c, k, top[c], titles[c]) for n, c, k in found], "name string, cluster int, leaf int, representative string, title string")


@query()
def cluster_upgma(spark, sf):  # noqa: ANN001, ANN201
    names = analysis.PROPERTIES
    return _clusters(spark, analysis.spearman(_means(spark, sf, names, ["quality"]), names, names, key="graph_id"), names, 0.75, analysis.PREFERENCE)


@query()
def cluster_metrics(spark, sf):  # noqa: ANN001, ANN201
    return _clusters(spark, analysis.spearman(clean(spark, sf), QUALITY, QUALITY, key="graph_id"), QUALITY, 0.85)


@query()
def cluster_layouts(spark, sf):  # noqa: ANN001, ANN201
    df = clean(spark, sf)
    names = sorted(r[0] for r in df.select("layout").distinct().collect())  # the registered layouts
    wide = df.groupBy("graph_id").pivot("layout", names).agg(F.max("quality"))
    safe = wide.toDF(*[c.replace("-", "_") for c in wide.columns])
    names = [n.replace("-", "_") for n in names]
    return _clusters(spark, analysis.spearman(safe, names, names, key="graph_id"), names, 0.70)


@query()
def shapley_r2(spark, sf):  # noqa: ANN001, ANN201
    from .q_tables import graphs

    groups = {"size": ["n_nodes", "n_edges"], "density": ["density", "mean_degree"], "distance": ["diameter", "avg_shortest_path_length"], "clustering": ["transitivity", "average_clustering"]}
    cols = [c for g in groups.values() for c in g]
    from ..functions.text import number

    df = clean(spark, sf).select("graph_id", "layout", "quality").join(graphs(spark, sf).select("graph_id", *(number(F.col(c).cast("double")).alias(c) for c in cols)), "graph_id")
    return spark.createDataFrame(analysis.shapley_r2(df, "quality", groups, layout="layout"), "feature string, share double")


GROUPS = {"size": ["n_nodes", "n_edges"], "density": ["density", "mean_degree"], "distance": ["diameter", "avg_shortest_path_length"], "clustering": ["transitivity", "average_clustering"]}


@query()
def shapley_boosted(spark, sf):  # noqa: ANN001, ANN201
    """Shares of held-out R2 of boosted trees: groups of invariants and the layout."""
    from ..functions.text import number
    from ..operators import attribution
    from .q_tables import graphs

    cols = [c for g in GROUPS.values() for c in g]
    df = clean(spark, sf).select("graph_id", "layout", "quality", "kruskal_stress").join(graphs(spark, sf).select("graph_id", *(number(F.col(c).cast("double")).alias(c) for c in cols)), "graph_id")
    return attribution.shapley_boosted(df, ["quality", "kruskal_stress"], GROUPS, ["graph_id", "layout"], layout="layout")


FITTED = ["n_nodes", "n_edges", "density", "max_degree", "diameter", "transitivity"]


@query(f"""WITH {CLEAN}, {FIRST_SQL}, e AS (SELECT graph_id, max(quality) AS m FROM q GROUP BY 1), r AS (SELECT count(*) AS n FROM e JOIN graphs g ON e.graph_id = g.graph_id WHERE m IS NOT NULL AND {' AND '.join(f"g.{c}::VARCHAR NOT IN ('nan', '-nan')" for c in FITTED)})
  SELECT unnest(['quality_max', 'quality_range']) AS target, n AS n_rows, true AS a_fifth_held_out, true AS r2_below_one FROM r""")
def envelope_fit(spark, sf):  # noqa: ANN001, ANN201
    """Boosted trees on all graphs for two envelope statistics: the rows that have all columns, whether a fifth of them is held out, and
    whether these have an R2 (the tables' scores are random, so there is little to learn; tests have what can be learnt)."""
    from ..functions.text import number
    from ..operators import attribution
    from .q_tables import graphs

    env = analysis.envelope(clean(spark, sf), "graph_id", ["quality"])
    df = env.join(graphs(spark, sf).select("graph_id", *(number(F.col(c).cast("double")).alias(c) for c in FITTED)), "graph_id")
    found = attribution.held_out_fit(materialize(df), ["quality_max", "quality_range"], [*FITTED, "n_drawings"], ["graph_id"])
    return spark.createDataFrame([(t, n + m, 0.1 < m / (n + m) < 0.3, r2 is not None and -1 < r2 < 1) for t, r2, n, m in found], "target string, n_rows long, a_fifth_held_out boolean, r2_below_one boolean")


@query()
def dedup_wl_vf2(spark, sf):  # noqa: ANN001, ANN201
    return isomorphism.isomorphism_classes(corpus.pack(edges(spark, sf)))


@query()
def generators_sample(spark, sf):  # noqa: ANN001, ANN201
    return generate.generated(spark, 500)


@query()
def generator_yield(spark, sf):  # noqa: ANN001, ANN201
    return generate.family_yield(spark, 1000)


@query()
def calibration_catalogue(spark, sf):  # noqa: ANN001, ANN201
    return generate.calibration(spark)


@query()
def exhaustive_small_graphs(spark, sf):  # noqa: ANN001, ANN201
    return generate.exhaustive_small(spark)
