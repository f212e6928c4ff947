"""Smaller operators of the inventory, each as a query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, corpus, flows, properties, tables
from ..scale import skew_join, small_or_not
from ..session import materialize
from ..sources import readers
from .q_corpus import edges
from .q_tables import FIRST_SQL, graphs
from .registry import query, table

SOURCE = "coalesce(CASE WHEN source <> '' THEN source END, generator)"


@query(f"WITH {FIRST_SQL} SELECT graph_id, {SOURCE} AS effective_source FROM graphs")
def effective_source(spark, sf):  # noqa: ANN001, ANN201
    return graphs(spark, sf).select("graph_id", F.coalesce(F.when(F.col("source") != "", F.col("source")), "generator").alias("effective_source"))


@query(f"WITH {FIRST_SQL} SELECT coalesce(source, '(none)') AS source, count(*) AS n FROM graphs GROUP BY 1 ORDER BY n DESC, source")
def source_sizes(spark, sf):  # noqa: ANN001, ANN201
    return graphs(spark, sf).groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT source, arg_min(category, row_id) AS category FROM manifest WHERE category IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def first_category(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "manifest").filter("category IS NOT NULL AND source IS NOT NULL").groupBy("source").agg(F.min_by("category", "row_id").alias("category"))


@query("""SELECT origin, count(*) AS n, count(DISTINCT graph_id) AS n_graphs FROM (SELECT 'manifest' AS origin, graph_id FROM manifest UNION ALL SELECT 'dedup', dropped_graph_id FROM dedup_audit UNION ALL SELECT 'sample', dropped_graph_id FROM sampling_audit) GROUP BY 1""")
def manifest_and_audits(spark, sf):  # noqa: ANN001, ANN201
    parts = [("manifest", "manifest", "graph_id"), ("dedup", "dedup_audit", "dropped_graph_id"), ("sample", "sampling_audit", "dropped_graph_id")]
    frames = {k: table(spark, sf, t).select(F.col(c).alias("graph_id")) for k, t, c in parts}
    return analysis.union_layouts(frames).withColumnRenamed("layout", "origin").groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("graph_id").alias("n_graphs"))


@query("SELECT layout, count(*) AS n FROM metrics GROUP BY 1 UNION ALL SELECT '(all)', count(*) FROM metrics")
def drawings_per_layout(spark, sf):  # noqa: ANN001, ANN201
    by = table(spark, sf, "metrics").groupBy("layout").agg(F.count("*").alias("n"))
    return by.unionByName(by.agg(F.lit("(all)").alias("layout"), F.sum("n").alias("n")))


CLUSTERS = [("circular", 0), ("random", 0), ("spectral", 1), ("FMMM", 2), ("HOLA", 3)]


@query(f"WITH c(layout, cluster) AS (VALUES {', '.join(map(str, CLUSTERS))}) SELECT m.layout, coalesce(c.cluster, -1) AS cluster, count(*) AS n FROM metrics m LEFT JOIN c ON m.layout = c.layout GROUP BY 1, 2")
def layout_cluster_map(spark, sf):  # noqa: ANN001, ANN201
    names = spark.createDataFrame(CLUSTERS, "layout string, cluster int")
    df = table(spark, sf, "metrics").select("layout").join(F.broadcast(names), "layout", "left")  # five rows
    return df.groupBy("layout", F.coalesce("cluster", F.lit(-1)).alias("cluster")).agg(F.count("*").alias("n"))


@query(f"WITH {FIRST_SQL}, l AS (SELECT DISTINCT layout FROM metrics), d AS (SELECT DISTINCT graph_id, layout FROM metrics) SELECT l.layout, count(*) AS tasks, count(*) FILTER (WHERE d.graph_id IS NULL) AS open FROM graphs g CROSS JOIN l LEFT JOIN d ON g.graph_id = d.graph_id AND l.layout = d.layout WHERE (l.layout <> 'planar' OR g.is_planar) AND (l.layout <> 'radial-tree' OR g.is_tree) GROUP BY 1")
def layout_tasks(spark, sf):  # noqa: ANN001, ANN201
    m = table(spark, sf, "metrics").select("graph_id", "layout")
    tasks = graphs(spark, sf).select("graph_id", "is_planar", "is_tree").crossJoin(small_or_not(materialize(m.select("layout").distinct())))
    tasks = tasks.filter("(layout <> 'planar' OR is_planar) AND (layout <> 'radial-tree' OR is_tree)")
    left = tables.not_done(tasks, m, ["graph_id", "layout"]).groupBy("layout").agg(F.count("*").alias("open"))
    return tasks.groupBy("layout").agg(F.count("*").alias("tasks")).join(left, "layout", "left").fillna(0, ["open"])


@query("SELECT graph_id, layout FROM (SELECT *, row_number() OVER (ORDER BY md5(graph_id || '|' || layout || '|7'), graph_id, layout) AS r FROM (SELECT DISTINCT graph_id, layout FROM metrics)) WHERE r <= 600")
def random_rows(spark, sf):  # noqa: ANN001, ANN201
    rows = table(spark, sf, "metrics").select("graph_id", "layout").distinct()
    return rows.orderBy(F.md5(F.concat_ws("|", "graph_id", "layout", F.lit("7"))), "graph_id", "layout").limit(600)


@query("WITH a AS (SELECT c_custkey AS id, c_nationkey AS k FROM customer), b AS (SELECT s_suppkey AS id, s_nationkey AS k FROM supplier) SELECT DISTINCT n_name AS graph_id, o_custkey AS customer, l_suppkey AS supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN a ON o_custkey = a.id JOIN b ON l_suppkey = b.id AND a.k = b.k JOIN nation ON a.k = n_nationkey")
def same_country_edges(spark, sf):  # noqa: ANN001, ANN201
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("graph_id"))
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("ka"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("kb"))
    pairs = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("supplier")).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer")), "l_orderkey").select("customer", "supplier").distinct()
    both = skew_join(skew_join(pairs, a, ["customer"]), b, ["supplier"]).filter("ka = kb")
    return both.join(small_or_not(nation), F.col("ka") == F.col("n_nationkey")).select("graph_id", "customer", "supplier")


@query(f"WITH li AS (SELECT DISTINCT o_custkey AS graph_id, l_orderkey AS ok, (l_partkey % 32)::BIGINT AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT DISTINCT a.graph_id, a.node AS u, b.node AS v FROM li a JOIN li b ON a.graph_id = b.graph_id AND a.ok = b.ok AND a.node < b.node) SELECT graph_id, count(*) AS n_edges, string_agg(u || '-' || v, ' ' ORDER BY u, v) AS edges FROM e GROUP BY 1")
def collected_edges(spark, sf):  # noqa: ANN001, ANN201
    rows = edges(spark, sf).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("e"))
    return rows.select("graph_id", F.size("e").cast("long").alias("n_edges"), F.array_join(F.transform("e", lambda x: F.concat_ws("-", x["u"].cast("string"), x["v"].cast("string"))), " ").alias("edges"))


@query("""WITH l AS (SELECT dropped_category AS source, kept_category AS target, count(*)::DOUBLE AS value FROM dedup_audit WHERE dropped_category IS NOT NULL AND kept_category IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT *, sum(value) OVER (PARTITION BY source) AS st, sum(value) OVER (PARTITION BY source ORDER BY target) AS sc, sum(value) OVER (PARTITION BY target) AS tt, sum(value) OVER (PARTITION BY target ORDER BY source) AS tc FROM l)
  SELECT source, target, value, round(sc / st * 100 - value / st * 100, 6) + 0.0 AS source_from, round(sc / st * 100, 6) AS source_to, round(tc / tt * 100 - value / tt * 100, 6) + 0.0 AS target_from, round(tc / tt * 100, 6) AS target_to FROM b""")
def link_bands(spark, sf):  # noqa: ANN001, ANN201
    links = table(spark, sf, "dedup_audit").filter("dropped_category IS NOT NULL AND kept_category IS NOT NULL").groupBy(F.col("dropped_category").alias("source"), F.col("kept_category").alias("target")).agg(F.count("*").cast("double").alias("value"))
    df = flows.link_bands(links, F.lit(100.0))
    return df.select("source", "target", "value", *((F.round(c, 6) + 0.0).alias(c) for c in ("source_from", "source_to", "target_from", "target_to")))


@query("""WITH g AS (SELECT layout, run_day, count(*) AS n FROM metrics GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY run_day, n DESC, layout) AS k FROM g) SELECT k, layout, run_day, coalesce(lag(run_day) OVER (ORDER BY k) <> run_day, false) AS new FROM o""")
def cluster_boundaries(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    counts = table(spark, sf, "metrics").groupBy("layout", "run_day").agg(F.count("*").alias("n"))
    ordered = counts.withColumn("k", F.row_number().over(Window.orderBy("run_day", F.desc("n"), "layout")))  # a row for each layout and day
    return flows.boundaries(ordered, "k", "run_day").select(F.col("k").cast("long").alias("k"), "layout", "run_day", "new")


@query("""SELECT event_type, count(*) AS n, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def json_params(spark, sf):  # noqa: ANN001, ANN201
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max(k).alias("most"))


@query("""SELECT graph_id, round(CASE WHEN n_nodes >= 2 THEN (CASE WHEN is_eulerian THEN n_edges * (1 - 0.5 / 2) WHEN is_tree THEN n_edges * 0.75 ELSE n_edges END) / (n_nodes * (n_nodes - 1.0) / 2) END, 6) AS estimate FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY row_id DESC) AS r FROM manifest) WHERE r = 1)""")
def estimated_density(spark, sf):  # noqa: ANN001, ANN201
    df = graphs(spark, sf)
    directed = F.coalesce(F.col("is_eulerian") | F.col("is_tree"), F.coalesce("is_eulerian", "is_tree", F.lit(False)))
    reciprocity = F.when(F.col("is_eulerian"), 0.5)
    return df.select("graph_id", F.round(readers.estimated_density(F.col("n_nodes").cast("double"), F.col("n_edges").cast("double"), directed, reciprocity), 6).alias("estimate"))


@query("""SELECT source, licence, NOT (coalesce(lower(licence), '') SIMILAR TO '.*(noncommercial|-nc-| nc ).*') AND (contains(coalesce(lower(licence), ''), 'cc0') OR contains(coalesce(lower(licence), ''), 'public domain') OR contains(coalesce(lower(licence), ''), 'cc by 4.0') OR contains(coalesce(lower(licence), ''), 'cc-by-4.0')) AS is_open FROM sources""")
def open_licences(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "sources").select("source", "licence", readers.is_open(F.col("licence")).alias("is_open"))


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def windowed_counts(spark, sf):  # noqa: ANN001, ANN201
    from ..streaming.ingest import windowed_counts as counts

    return counts(table(spark, sf, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def property_timings(spark, sf):  # noqa: ANN001, ANN201
    return properties.timings(corpus.pack(edges(spark, sf)))


@query()
def layout_baur_brandes(spark, sf):  # noqa: ANN001, ANN201
    from ..operators.scoring import laid_out_and_scored

    return laid_out_and_scored(graphs_packed(spark, sf), ["baur-brandes", "circular"])


@query()
def layout_planar_layered(spark, sf):  # noqa: ANN001, ANN201
    from ..operators.scoring import laid_out_and_scored

    return laid_out_and_scored(graphs_packed(spark, sf), ["planar", "sugiyama"])


@query()
def layout_forces(spark, sf):  # noqa: ANN001, ANN201
    from ..operators.scoring import laid_out_and_scored

    return laid_out_and_scored(graphs_packed(spark, sf), ["kamada-kawai", "forceatlas2", "fruchterman-reingold"])


def graphs_packed(spark, sf):  # noqa: ANN001, ANN201
    """Every graph of the tables and of the calibration catalogue."""
    from ..operators import generate

    own = corpus.pack(edges(spark, sf)).withColumn("graph_id", F.col("graph_id").cast("string"))
    return own.unionByName(generate.calibration(spark).select("graph_id", "n", "us", "vs"))


@query()
def drawings_svg(spark, sf):  # noqa: ANN001, ANN201
    from ..operators.scoring import laid_out
    from ..sources.sinks import svg

    drawn = laid_out(graphs_packed(spark, sf), ["circular", "stress-majorization"])
    points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y")))
    return drawn.select("graph_id", "layout", "outcome", svg(points, F.col("paths")).alias("svg"))
