"""Queries on sources and sinks: graphs of the tables written in every format and read back, staging, paths, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from ..operators import corpus, generate, scoring, tables
from ..session import shared_dir
from ..sources import readers, sinks, writers
from .q_corpus import CAP, DENSITY, EDGES, REACH, edges, packed
from .q_drawings import FUSED
from .q_tables import FIRST_SQL, SAMPLE_SQL, _pool, graphs
from .registry import query, table

NUMBERED = f"""WITH {EDGES}, num AS (SELECT graph_id, node, dense_rank() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS k FROM deg)
  SELECT e.graph_id::VARCHAR AS name, least(a.k, b.k)::INT AS u, greatest(a.k, b.k)::INT AS v FROM edges e JOIN num a ON e.graph_id = a.graph_id AND e.u = a.node JOIN num b ON e.graph_id = b.graph_id AND e.v = b.node"""


def read_back(packed: DataFrame, fmt: str) -> DataFrame:
    """(name, u, v) of graphs that were written in a format and parsed again, by the numbers that they had before. A file is
    parsed in the task that wrote it, one after the other, so none of them travels."""
    schema = T._parse_datatype_string("path string, us array<int>, vs array<int>, orig_ids array<string>, problem string")
    parsed = packed.select("graph_id", "n", "us", "vs").mapInPandas(lambda batches: readers.parsed(writers.files(batches, fmt), fmt, True, schema.names), schema)
    label = lambda i: F.element_at("orig_ids", i + 1).cast("int") - writers.FIRST.get(fmt, 0)
    ends = parsed.filter("problem IS NULL").select(F.regexp_extract("path", r"(\d+)\.dat$", 1).alias("name"), "orig_ids", F.explode(F.arrays_zip("us", "vs")).alias("e"))
    return ends.select("name", F.least(label(F.col("e.us")), label(F.col("e.vs"))).alias("u"), F.greatest(label(F.col("e.us")), label(F.col("e.vs"))).alias("v"))


def _format_query(fmt: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return read_back(corpus.pack(edges(spark, sf)), fmt)

    run.__doc__ = f"Every graph written as {fmt} and read back."
    return run


for _fmt in writers.WRITERS:
    query(NUMBERED, name=f"format_{_fmt}")(_format_query(_fmt))


@query(f"""WITH RECURSIVE {EDGES}, {REACH}, j AS (SELECT c_acctbal < 0 AS known, n_nodes, n_edges, n_components FROM sizes JOIN comps USING (graph_id) JOIN customer ON c_custkey = graph_id)
  SELECT CASE WHEN known THEN 'already_in_manifest' WHEN NOT n_nodes BETWEEN 8 AND 75 THEN 'out_of_size' WHEN n_edges = 0 THEN 'no_edges' WHEN n_components > 1 THEN 'disconnected' WHEN {DENSITY} > {CAP} THEN 'over_density_cap' ELSE 'accepted' END AS reason, count(*) AS n FROM j GROUP BY 1""")
def staged_reasons(spark, sf):  # noqa: ANN001, ANN201
    """A source of GraphML files staged, where the graphs of customers in debt are known already."""
    known = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("orders_"), F.col("c_custkey"), F.lit(".graphml")).alias("graph_id"))
    files = writers.encoded(corpus.pack(edges(spark, sf)), "graphml")
    _, reasons = readers.stage(readers.parse_files(files, "graphml"), "orders", "real_world", known)
    return reasons.select("reason", "n")


@query(f"""WITH RECURSIVE {EDGES}, {REACH}, j AS (SELECT graph_id, 'orders_' || graph_id || '.graphml' AS id FROM sizes JOIN comps USING (graph_id) WHERE n_nodes BETWEEN 8 AND 75 AND n_components = 1 AND {DENSITY} <= {CAP})
  SELECT id AS graph_id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM j) WHERE r <= 150""")
def staged_with_cap(spark, sf):  # noqa: ANN001, ANN201
    """The first 150 graphs, by id, that pass every filter: the cap is the feature."""
    files = writers.encoded(corpus.pack(edges(spark, sf)), "edge_list")
    kept, _ = readers.stage(readers.parse_files(files, "edge_list"), "orders", "real_world", None, cap=150)
    return kept.select("graph_id")


PLACED = "category IN ('generated', 'calibration') AND coalesce(source, '') = '' OR category IN ('benchmark', 'real_world', 'graphs_with_drawings') AND coalesce(source, '') <> ''"


@query(f"""WITH {FIRST_SQL} SELECT graph_id, CASE WHEN category = 'graphs_with_drawings' THEN 'graphs-with-drawings/' || source || '/' || graph_id WHEN source <> '' THEN 'graphs/' || category || '/' || source || '/' || graph_id ELSE 'graphs/' || category || '/' || graph_id END AS graph_path,
  CASE WHEN source <> '' THEN 'drawings/HOLA/' || category || '/' || source || '/' || graph_id ELSE 'drawings/HOLA/' || category || '/' || graph_id END AS drawing_path FROM graphs WHERE {PLACED}""")
def file_paths(spark, sf):  # noqa: ANN001, ANN201
    """Where the files of every graph with a proper category and source are."""
    df = graphs(spark, sf).filter(PLACED)
    c, s, g = F.col("category"), F.col("source"), F.col("graph_id")
    return df.select("graph_id", sinks.graph_path(c, s, g).alias("graph_path"), sinks.drawing_path(F.lit("HOLA"), c, s, g).alias("drawing_path"))


@query(f"WITH {FIRST_SQL} SELECT category, count(*) AS n, count(DISTINCT source) AS n_sources FROM graphs WHERE category IN ('generated', 'calibration') OR category IN ('benchmark', 'real_world', 'graphs_with_drawings') AND coalesce(source, '') <> '' GROUP BY 1")
def checked_manifest(spark, sf):  # noqa: ANN001, ANN201
    """The rows that a manifest may have pass the check unchanged."""
    good = F.coalesce(F.col("category").isin(*readers.CATEGORIES) & (~F.col("category").isin(*readers.NESTED) | (F.coalesce("source", F.lit("")) != "")), F.lit(False))
    return sinks.checked(graphs(spark, sf).filter(good)).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


FLAGS = ["is_bipartite", "is_planar", "is_tree", "is_forest", "is_regular", "is_eulerian"]
WHOLE = ["n_nodes", "n_edges", "min_degree", "max_degree", "n_triangles", "degeneracy"]
REAL = ["density", "mean_degree", "diameter", "average_clustering", "degree_assortativity", "crossing_number_lb_bipartite"]


@query(f"WITH {FIRST_SQL} SELECT graph_id, {', '.join(FLAGS)}, {', '.join(WHOLE)}, {', '.join(f'round(CASE WHEN {c}::VARCHAR NOT IN (' + repr('nan') + ', ' + repr('-nan') + f') THEN {c} END, 6) + 0.0 AS {c}' for c in REAL)} FROM graphs")
def manifest_through_csv(spark, sf):  # noqa: ANN001, ANN201
    """The manifest written as CSV, doubles with nine digits and missing ones as nan, and read by its fixed schema."""
    at = f"{shared_dir(spark).rstrip('/')}/graphmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    sinks.csv_text(graphs(spark, sf).select("graph_id", *FLAGS, *WHOLE, *REAL)).write.option("header", "true").csv(at)
    back = readers.read_manifest(spark, at)
    return back.select("graph_id", *FLAGS, *WHOLE, *((F.round(c, 6) + 0.0).alias(c) for c in REAL))


@query("""WITH c AS (SELECT dropped_source AS s, run_no, scope, count(*) AS n FROM dedup_audit WHERE dropped_source IS NOT NULL AND scope IS NOT NULL AND run_no IS NOT NULL AND dropped_source <> '' AND NOT contains(dropped_source, ']') GROUP BY 1, 2, 3),
  l AS (SELECT *, max(run_no) OVER (PARTITION BY s) AS last FROM c) SELECT scope AS reason, sum(n)::BIGINT AS n FROM l WHERE run_no = last GROUP BY 1""")
def reasons_from_log(spark, sf):  # noqa: ANN001, ANN201
    """Lines of a log, one for each source and run, of which the last of each source counts."""
    rows = table(spark, sf, "dedup_audit").filter("dropped_source IS NOT NULL AND scope IS NOT NULL AND run_no IS NOT NULL AND dropped_source <> '' AND NOT contains(dropped_source, ']')")
    counts = rows.groupBy("dropped_source", "run_no", "scope").agg(F.count("*").alias("n"))
    entries = F.array_join(F.array_sort(F.collect_list(F.format_string("'%s': %d", "scope", "n"))), ", ")
    lines = counts.groupBy("dropped_source", "run_no").agg(entries.alias("e")).select(F.format_string("[%s] kept=1,234  reasons={%s}  n_min=8", "dropped_source", "e").alias("value"), F.col("run_no").alias("line_no"))
    return readers.log_totals(lines)


@query(f"{SAMPLE_SQL} UNION ALL SELECT graph_id, source, n_nodes, CASE WHEN density::VARCHAR NOT IN ('nan', '-nan') THEN density END FROM graphs WHERE category IS DISTINCT FROM 'real_world'")
def sampled_manifest(spark, sf):  # noqa: ANN001, ANN201
    """The manifest after sampling: the sample of real_world, and all other rows, those of no category too."""
    others = graphs(spark, sf).filter("category IS DISTINCT FROM 'real_world'").select("graph_id", "source", "n_nodes", "density")
    return others.unionByName(tables.stratified_sample(_pool(spark, sf), 30))


@query(f"""WITH {FIRST_SQL}, i AS (SELECT DISTINCT category, coalesce(CASE WHEN trim(source) <> '' THEN source END, generator) AS g, graph_id FROM graphs),
  v AS (SELECT graph_id FROM (SELECT *, row_number() OVER (PARTITION BY category, g ORDER BY graph_id) AS r FROM i) WHERE r <= 2)
  SELECT graph_id, graph_id IN (SELECT graph_id FROM v) AS first FROM graphs""")
def verify_first(spark, sf):  # noqa: ANN001, ANN201
    """Which graphs are laid out before all others: two of each cohort and source."""
    df = graphs(spark, sf)
    first = tables.top_ids(df, 2).select("graph_id", F.lit(True).alias("first")).distinct()
    return df.select("graph_id").join(first, "graph_id", "left").fillna(False, ["first"])


@query("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 2), (4, 6), (5, 21), (6, 112), (7, 853)) t(n_nodes, n_graphs)")
def small_graphs_by_size(spark, sf):  # noqa: ANN001, ANN201
    """How many connected graphs of each size the exhaustive cohort has; the SQL has the known numbers."""
    return generate.exhaustive_small(spark).groupBy(F.col("n").alias("n_nodes")).agg(F.count("*").cast("int").alias("n_graphs"))


@query("""SELECT family, n_graphs, true AS sizes_right FROM (VALUES ('K', 6), ('petersen', 1), ('heawood', 1), ('pappus', 1), ('desargues', 1), ('dodecahedral', 1), ('truncated_tetrahedron', 1), ('truncated_cube', 1), ('octahedral', 1)) t(family, n_graphs)""")
def calibration_families(spark, sf):  # noqa: ANN001, ANN201
    """Complete graphs and named polyhedra of the catalogue: how many, and whether all have the edges their kind asks for."""
    name = F.regexp_replace("graph_id", r"^calibration_|_n\d+_m\d+\.graphml$", "")
    df = generate.calibration(spark).select(name.alias("name"), "n", F.size("us").alias("m"))
    degree = {"petersen": 3, "heawood": 3, "pappus": 3, "desargues": 3, "dodecahedral": 3, "truncated_tetrahedron": 3, "truncated_cube": 3, "octahedral": 4}
    want = F.when(F.col("name").rlike(r"^K_\d+$"), F.expr("n * (n - 1) div 2"))
    for k, d in degree.items():
        want = want.when(F.col("name") == k, F.expr(f"n * {d} div 2"))
    family = F.when(F.col("name").rlike(r"^K_\d+$"), F.lit("K")).when(F.col("name").isin(*degree), F.col("name"))
    return df.withColumns({"family": family, "want": want}).filter("family IS NOT NULL").groupBy("family").agg(F.count("*").cast("int").alias("n_graphs"), F.bool_and(F.col("m") == F.col("want")).alias("sizes_right"))


TREES = ("tree_uniform", "caterpillar")


@query("SELECT unnest(['bba', 'caterpillar', 'er', 'geo', 'hrg', 'k_regular', 'k_tree', 'lfr', 'nws', 'planar_max', 'sbm', 'tree_uniform']) AS generator, true AS within_bounds, true AS kind_right")
def generator_checks(spark, sf):  # noqa: ANN001, ANN201
    """Of each family's valid draws: whether sizes and densities are within bounds, and whether trees are trees, planar graphs
    keep to 3 n - 6 edges, regular graphs share 2 m evenly, and k-trees have at least 2 n - 3."""
    df = generate.draws(spark, 4000).filter("valid").select("generator", "n", F.size("us").alias("m"))
    bounds = F.col("n").between(8, 75) & (corpus.density(F.col("n"), F.col("m")) <= corpus.density_cap(F.col("n"))) & (F.col("m") >= F.col("n") - 1)
    kind = F.when(F.col("generator").isin(*TREES), F.col("m") == F.col("n") - 1).when(F.col("generator") == "planar_max", F.col("m") <= 3 * F.col("n") - 6).when(F.col("generator") == "k_regular", 2 * F.col("m") % F.col("n") == 0).when(F.col("generator") == "k_tree", F.col("m") >= 2 * F.col("n") - 3).otherwise(F.lit(True))
    return df.groupBy("generator").agg(F.bool_and(bounds).alias("within_bounds"), F.bool_and(kind).alias("kind_right"))


@query(f"WITH {EDGES}, n AS (SELECT count(*) AS n FROM sizes), t AS (SELECT count(*) AS n FROM sizes WHERE n_edges = n_nodes - 1) SELECT unnest({FUSED}) AS layout, unnest([n.n, n.n, n.n, n.n, n.n, n.n, n.n]) AS n_graphs, true AS within_bounds, true AS circle_fits FROM n")
def layout_bounds(spark, sf):  # noqa: ANN001, ANN201
    """Seven layouts of every graph: each has an outcome, ok or not_applicable (only radial-tree may have that), every score is in
    [0, 1], and circles are nearly square."""
    df = scoring.laid_out_and_scored(packed(spark, sf), FUSED)
    inside = F.lit(True)
    for c in scores.NAMES:
        inside = inside & F.coalesce(F.col(c).between(-1e-9, 1 + 1e-9), F.lit(True))
    told = (F.col("outcome") == "ok") | ((F.col("outcome") == "not_applicable") & (F.col("layout") == "radial-tree"))
    fits = (F.col("layout") != "circular") | (F.col("aspect_ratio") > 0.8) | F.col("aspect_ratio").isNull() | (F.col("node_resolution") > 0.3)
    return df.groupBy("layout").agg(F.count("*").alias("n_graphs"), F.bool_and(inside & told).alias("within_bounds"), F.bool_and(fits).alias("circle_fits"))


@query(f"WITH {EDGES} SELECT graph_id, n_edges < 9 OR n_nodes < 5 AS is_planar FROM sizes WHERE n_nodes >= 3 AND n_edges > 3 * n_nodes - 6 OR n_edges < 9 OR n_nodes < 5")
def planar_by_counts(spark, sf):  # noqa: ANN001, ANN201
    """Planarity of the graphs for which the numbers of nodes and edges decide it."""
    from ..operators import properties

    packed = corpus.pack(edges(spark, sf))
    decided = packed.filter("n >= 3 AND size(us) > 3 * n - 6 OR size(us) < 9 OR n < 5")
    return corpus.per_graph(decided, properties.deep_kernel, "is_planar boolean")
