"""Queries on the upkeep of manifest, scores and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..operators.properties import NAMES
from .registry import query, table

METRICS = [
    "angular_resolution", "aspect_ratio", "crossing_angle", "edge_crossings", "edge_length_deviation", "edge_orthogonality", "gabriel_ratio_nodes", "kruskal_stress",
    "neighbourhood_preservation", "node_edge_occlusion", "node_resolution", "node_uniformity",
]
LATEST = ["run_day", "scored_at", *METRICS, "contains_bends", "contains_curves"]
NUMBERS = f"scored AS (SELECT * REPLACE ({', '.join(f"CASE WHEN {c}::VARCHAR NOT IN ('nan', '-nan') THEN {c} END AS {c}" for c in METRICS)}) FROM metrics)"
LAST_SQL = f"{NUMBERS}, drawn AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, layout ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in LATEST)}) AS n FROM scored) WHERE n = 1)"
FIRST_SQL = "graphs AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY row_id DESC) AS n FROM manifest) WHERE n = 1)"


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    """metrics with the last write of each drawing."""
    return tables.last_writes(table(spark, sf, "metrics"), ["graph_id", "layout"], [F.col(c).desc_nulls_last() for c in LATEST])


def graphs(spark: SparkSession, sf: str) -> DataFrame:
    """manifest with the last row of each graph."""
    return tables.last_writes(table(spark, sf, "manifest"), ["graph_id"], [F.desc("row_id")])


@query("""SELECT DISTINCT graph_id FROM (SELECT graph_id FROM manifest UNION SELECT dropped_graph_id FROM dedup_audit UNION SELECT dropped_graph_id FROM sampling_audit) WHERE graph_id IS NOT NULL""")
def known_ids_union(spark, sf):  # noqa: ANN001, ANN201
    return tables.known_ids((table(spark, sf, "manifest"), "graph_id"), (table(spark, sf, "dedup_audit"), "dropped_graph_id"), (table(spark, sf, "sampling_audit"), "dropped_graph_id"))


@query("""SELECT DISTINCT graph_id FROM metrics WHERE graph_id NOT IN (SELECT graph_id FROM manifest WHERE graph_id IS NOT NULL UNION SELECT dropped_graph_id FROM dedup_audit WHERE dropped_graph_id IS NOT NULL UNION SELECT dropped_graph_id FROM sampling_audit WHERE dropped_graph_id IS NOT NULL)""")
def resume_anti_join(spark, sf):  # noqa: ANN001, ANN201
    return tables.not_done(table(spark, sf, "metrics").select("graph_id").distinct(), known_ids_union(spark, sf), ["graph_id"])


@query("SELECT layout, count(*) AS n, count(DISTINCT graph_id) AS n_graphs FROM metrics WHERE graph_id IN (SELECT graph_id FROM manifest) GROUP BY 1")
def orphan_semi_join(spark, sf):  # noqa: ANN001, ANN201
    kept = tables.without_orphans(table(spark, sf, "metrics").select("graph_id", "layout"), table(spark, sf, "manifest"))
    return kept.groupBy("layout").agg(F.count("*").alias("n"), F.countDistinct("graph_id").alias("n_graphs"))


@query(f"WITH {LAST_SQL} SELECT graph_id, layout, run_day, round(kruskal_stress, 6) AS kruskal_stress, round(edge_crossings, 6) AS edge_crossings FROM drawn")
def last_write_wins(spark, sf):  # noqa: ANN001, ANN201
    return drawn(spark, sf).select("graph_id", "layout", "run_day", F.round("kruskal_stress", 6).alias("kruskal_stress"), F.round("edge_crossings", 6).alias("edge_crossings"))


@query("""WITH i AS (SELECT DISTINCT category, coalesce(CASE WHEN trim(source) <> '' THEN source END, generator) AS "group", graph_id FROM manifest)
  SELECT category, "group", graph_id FROM (SELECT *, row_number() OVER (PARTITION BY category, "group" ORDER BY graph_id) AS n FROM i) WHERE n <= 3""")
def verify_topk(spark, sf):  # noqa: ANN001, ANN201
    return tables.top_ids(table(spark, sf, "manifest"), 3)


CAP = 30
EDGES_Q = [i / tables.BINS for i in range(tables.BINS + 1)]


def _bin(x: str, e: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND len({e}) > 1 THEN greatest(0, len(list_filter({e}, lambda q: q < {x})) - 1) END"


SAMPLE_SQL = f"""WITH {FIRST_SQL}, g AS (SELECT graph_id, source, n_nodes, CASE WHEN density::VARCHAR NOT IN ('nan', '-nan') THEN density END AS density FROM graphs WHERE category = 'real_world'),
  q AS (SELECT source, list_sort(list_distinct(quantile_cont(n_nodes::DOUBLE, {EDGES_Q}))) AS en, list_sort(list_distinct(quantile_cont(density, {EDGES_Q}))) AS ed FROM g GROUP BY 1),
  m AS (SELECT g.*, coalesce(({_bin("n_nodes", "en")})::VARCHAR, '<NA>') || '_' || coalesce(({_bin("density", "ed")})::VARCHAR, '<NA>') AS stratum FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source),
  c AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM (SELECT source, stratum, count(*) AS n FROM m GROUP BY 1, 2)),
  s AS (SELECT *, round_even(n * least({CAP}, total)::DOUBLE / total, 0)::BIGINT AS share FROM c), o AS (SELECT *, least(greatest(share, 1), n) AS own FROM s),
  d AS (SELECT *, sum(own) OVER (PARTITION BY source) - least({CAP}, total) AS over FROM o),
  u AS (SELECT source, stratum, over, unnest(range(1, (1 + CASE WHEN over > 0 THEN least(own, over) ELSE least(n - own, -over) END)::BIGINT)) AS u, own, share, n FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY over > 0 AND u = own, CASE WHEN over > 0 THEN own - share - u ELSE n - own - u END DESC, stratum) AS r FROM u),
  v AS (SELECT source, stratum, count(*) AS moved FROM r WHERE r <= abs(over) GROUP BY 1, 2),
  k AS (SELECT d.source, d.stratum, d.own - sign(d.over)::BIGINT * coalesce(moved, 0) AS quota FROM d LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source AND d.stratum = v.stratum),
  f AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY md5(concat_ws('|', 'sample', source, graph_id))) AS r FROM m)
  SELECT graph_id, f.source, n_nodes, density FROM f JOIN k ON f.source IS NOT DISTINCT FROM k.source AND f.stratum = k.stratum WHERE r <= quota"""


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return graphs(spark, sf).filter("category = 'real_world'").select("graph_id", "source", "n_nodes", "density")


@query(SAMPLE_SQL)
def stratified_sample(spark, sf):  # noqa: ANN001, ANN201
    return tables.stratified_sample(_pool(spark, sf), CAP)


@query(f"""WITH {FIRST_SQL}, p AS (SELECT source, count(*) AS n FROM graphs WHERE category = 'real_world' GROUP BY 1)
  SELECT source, greatest(0, n - {CAP})::BIGINT AS n_dropped, n AS n_total FROM p WHERE n > {CAP}""")
def sample_audit(spark, sf):  # noqa: ANN001, ANN201
    pool = _pool(spark, sf)
    kept = stratified_sample(spark, sf).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_kept"))
    df = pool.groupBy("source").agg(F.count("*").alias("n_total")).join(kept, F.col("source").eqNullSafe(F.col("s")), "left")
    return df.select("source", (F.col("n_total") - F.coalesce("n_kept", F.lit(0))).alias("n_dropped"), "n_total").filter("n_dropped > 0")


@query(f"""WITH {FIRST_SQL}, g AS (SELECT graph_id, source, n_nodes, CASE WHEN density::VARCHAR NOT IN ('nan', '-nan') THEN density END AS density FROM graphs),
  q AS (SELECT source, list_sort(list_distinct(quantile_cont(n_nodes::DOUBLE, {EDGES_Q}))) AS en, list_sort(list_distinct(quantile_cont(density, {EDGES_Q}))) AS ed FROM g GROUP BY 1)
  SELECT source, coalesce(({_bin("n_nodes", "en")})::VARCHAR, '<NA>') || '_' || coalesce(({_bin("density", "ed")})::VARCHAR, '<NA>') AS stratum, count(*) AS n FROM (SELECT g.*, en, ed FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source) GROUP BY 1, 2""")
def strata_counts(spark, sf):  # noqa: ANN001, ANN201
    return tables.strata(graphs(spark, sf)).groupBy("source", "stratum").agg(F.count("*").alias("n"))


KEYS = ["n_nodes", "n_edges", "max_degree"]
RANKED = """r AS (SELECT graph_id, source, category, n_nodes, n_edges, max_degree, CASE WHEN category = 'graphs_with_drawings' OR generator = 'exhaustive_small' THEN 0 WHEN coalesce(category = 'benchmark' OR source = 'houseofgraphs' OR starts_with(source, 'netzschleuder'), false) THEN 1 ELSE 2 END AS tier FROM graphs),
  z AS (SELECT r.*, count(*) OVER (PARTITION BY coalesce(source, '(none)')) AS source_size FROM r),
  c AS (SELECT *, count(*) OVER k AS class_size, first_value(graph_id) OVER w AS kg, first_value(source) OVER w AS ks, first_value(category) OVER w AS kc FROM z
    WINDOW k AS (PARTITION BY n_nodes, n_edges, max_degree), w AS (PARTITION BY n_nodes, n_edges, max_degree ORDER BY tier, source_size, graph_id))"""


def classes(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    df = graphs(spark, sf)
    df = df.select("graph_id", "source", "category", *keys, tables.tier(F.col("category"), F.col("generator"), F.col("source")).alias("tier"))
    df = tables.with_source_size(df)
    return tables.duplicates(df, keys, [F.col("tier"), F.col("source_size"), F.col("graph_id")])


@query(f"""WITH {FIRST_SQL}, {RANKED} SELECT graph_id AS dropped_graph_id, source AS dropped_source, category AS dropped_category, kg AS kept_graph_id, ks AS kept_source, kc AS kept_category, class_size AS iso_class_size,
  CASE WHEN coalesce(source, '') = coalesce(ks, '') THEN 'within-source' ELSE 'cross-source' END AS scope FROM c WHERE class_size > 1 AND graph_id <> kg AND tier <> 0""")
def dedup_properties(spark, sf):  # noqa: ANN001, ANN201
    return tables.dedup_audit(classes(spark, sf, KEYS))


@query(f"WITH {FIRST_SQL}, {RANKED} SELECT n_nodes, n_edges, max_degree, max(kg) AS winner, max(class_size) AS class_size FROM c WHERE class_size > 1 GROUP BY 1, 2, 3")
def dedup_winner(spark, sf):  # noqa: ANN001, ANN201
    return classes(spark, sf, KEYS).filter("class_size > 1").groupBy(*KEYS).agg(F.max("kept_graph_id").alias("winner"), F.max("class_size").alias("class_size"))


FLOATS = ["density", "mean_degree", "degree_std", "diameter", "radius", "avg_shortest_path_length", "average_clustering", "transitivity", "degree_assortativity", "crossing_number_lb_bipartite"]


@query("WITH " + FIRST_SQL + ", k AS (SELECT " + ", ".join(f"round(CASE WHEN {c}::VARCHAR NOT IN ('nan', '-nan') THEN {c} END, 6) AS {c}" if c in FLOATS else c for c in NAMES) + " FROM graphs) SELECT n AS class_size, count(*) AS n_classes FROM (SELECT count(*) AS n FROM k GROUP BY " + ", ".join(NAMES) + ") GROUP BY 1")
def property_collisions(spark, sf):  # noqa: ANN001, ANN201
    from ..functions.text import number

    keys = [F.round(number(F.col(c)), 6).alias(c) if c in FLOATS else F.col(c) for c in NAMES]
    return graphs(spark, sf).select(*keys).groupBy(*NAMES).agg(F.count("*").alias("class_size")).groupBy("class_size").agg(F.count("*").alias("n_classes"))
