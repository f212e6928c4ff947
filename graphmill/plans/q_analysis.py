"""Queries of the analysis: drawings joined with graphs, envelopes, correlations, variance, bins, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number
from ..operators import analysis, tables
from ..scale import skew_join
from .q_tables import FIRST_SQL, LAST_SQL, drawn, graphs
from .registry import query, table

Q, E = analysis.QUALITY, analysis.EMPIRICAL
ALL = [*Q, "gabriel_ratio_nodes"]


def _num(c: str) -> str:
    # not isnan(): DuckDB folds it by the file's statistics, which leave NaN out
    return f"CASE WHEN ({c})::VARCHAR NOT IN ('nan', '-nan') THEN {c} END"


def _mean(names: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in names)
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in names)
    return f"CASE WHEN {n} > 0 THEN ({total}) / ({n}) END"


CLEAN = f"{LAST_SQL}, clean AS (SELECT graph_id, layout, {', '.join(f'{_num(c)} AS {c}' for c in ALL)} FROM drawn), q AS (SELECT *, {_mean(Q)} AS quality, {_mean(E)} AS empirical_quality FROM clean)"


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """The last write of each drawing, NaN as null, with the composite scores."""
    df = drawn(spark, sf).select("graph_id", "layout", *(number(F.col(c)).alias(c) for c in ALL))
    return df.withColumn("quality", analysis.mean_of(Q)).withColumn("empirical_quality", analysis.mean_of(E))


#: Places of means of scores: scores have six, and the mean of up to 16 such numbers that ends at all ends at ten.
FINE = 10


def rounded(df: DataFrame, *keep: str, places: int = 6) -> DataFrame:
    """df with all columns but keep rounded."""
    return df.select(*(c if c in keep else (F.round(c, places) + 0.0).alias(c) for c in df.columns))


@query(f"""WITH {LAST_SQL}, {FIRST_SQL}, a AS (SELECT 'circular' AS layout, graph_id, kruskal_stress, NULL AS node_uniformity FROM drawn WHERE layout = 'circular' UNION ALL SELECT 'spectral', graph_id, kruskal_stress, node_uniformity FROM drawn WHERE layout = 'spectral')
  SELECT a.layout, coalesce(g.category, '(none)') AS category, count(*) AS n, count(g.graph_id) AS n_in_manifest, count({_num('node_uniformity')}) AS n_uniformity FROM a LEFT JOIN graphs g ON a.graph_id = g.graph_id GROUP BY 1, 2""")
def drawings_union_join(spark, sf):  # noqa: ANN001, ANN201
    d = drawn(spark, sf)
    frames = {"circular": d.filter("layout = 'circular'").select("graph_id", "kruskal_stress"), "spectral": d.filter("layout = 'spectral'").select("graph_id", "kruskal_stress", "node_uniformity")}
    known = graphs(spark, sf).select("graph_id", "category", F.lit(1).alias("known"))
    df = skew_join(analysis.union_layouts(frames), known, ["graph_id"], "left")
    return df.groupBy("layout", F.coalesce("category", F.lit("(none)")).alias("category")).agg(F.count("*").alias("n"), F.count("known").alias("n_in_manifest"), F.count(number(F.col("node_uniformity"))).alias("n_uniformity"))


@query(f"WITH {CLEAN} SELECT graph_id, layout, round(quality, {FINE}) AS quality, round(empirical_quality, {FINE}) AS empirical_quality FROM q")
def quality_composite(spark, sf):  # noqa: ANN001, ANN201
    return rounded(clean(spark, sf).select("graph_id", "layout", "quality", "empirical_quality"), "graph_id", "layout", places=FINE)


def _env(names: list[str]) -> str:
    return ", ".join(f"round(min({m}), {FINE}) + 0.0 AS {m}_min, round(max({m}), {FINE}) + 0.0 AS {m}_max, round(avg({m}), {FINE}) + 0.0 AS {m}_mean, round(max({m}) - min({m}), {FINE}) + 0.0 AS {m}_range" for m in names)


@query(f"WITH {CLEAN} SELECT graph_id, count(*) AS n_drawings, {_env(Q)} FROM q GROUP BY 1")
def envelope(spark, sf):  # noqa: ANN001, ANN201
    return rounded(analysis.envelope(clean(spark, sf), "graph_id", Q), "graph_id", "n_drawings", places=FINE)


@query(f"WITH {CLEAN}, {FIRST_SQL}, e AS (SELECT graph_id, count(*) AS n_drawings, {_env(['quality', 'empirical_quality'])} FROM q GROUP BY 1) SELECT e.*, g.n_nodes, g.n_edges FROM e LEFT JOIN graphs g ON e.graph_id = g.graph_id")
def envelope_plus(spark, sf):  # noqa: ANN001, ANN201
    e = rounded(analysis.envelope(clean(spark, sf), "graph_id", ["quality", "empirical_quality"]), "graph_id", "n_drawings", places=FINE)
    return e.join(graphs(spark, sf).select("graph_id", "n_nodes", "n_edges"), "graph_id", "left")


EVERY = [*Q, "quality", "empirical_quality"]


def _eta() -> str:
    parts = []
    for m in EVERY:
        parts.append(f"""SELECT '{m}' AS metric, unnest(['graph_id', 'layout', 'residual']) AS factor, round(unnest([(s0 - s1) / s0, (s1 - s2) / s0, s2 / s0]), 6) + 0.0 AS share FROM (
          SELECT sum(r0 * r0) AS s0, sum(r1 * r1) AS s1, sum(r2 * r2) AS s2 FROM (SELECT *, r1 - avg(r1) OVER (PARTITION BY layout) AS r2 FROM (SELECT *, r0 - avg(r0) OVER (PARTITION BY graph_id) AS r1 FROM (SELECT graph_id, layout, {m} - avg({m}) OVER () AS r0 FROM q WHERE {m} IS NOT NULL))))""")
    return f"WITH {CLEAN} " + " UNION ALL ".join(parts)


@query(_eta())
def eta2_variance(spark, sf):  # noqa: ANN001, ANN201
    return rounded(analysis.sequential_variance(clean(spark, sf).select("graph_id", "layout", *EVERY), EVERY, ["graph_id", "layout"]), "metric", "factor")


@query(f"SELECT metric, component, round(value, 6) + 0.0 AS value FROM (SELECT metric, component, value FROM (UNPIVOT (SELECT metric, max(CASE WHEN factor = 'graph_id' THEN share END) AS graph, max(CASE WHEN factor = 'layout' THEN share END) AS layout, max(CASE WHEN factor = 'residual' THEN share END) AS residual FROM ({_eta()}) GROUP BY 1) ON graph, layout, residual INTO NAME component VALUE value))")
def unpivot_components(spark, sf):  # noqa: ANN001, ANN201
    wide = eta2_variance(spark, sf).groupBy("metric").pivot("factor", ["graph_id", "layout", "residual"]).agg(F.first("share")).withColumnRenamed("graph_id", "graph")
    return rounded(wide.unpivot("metric", ["graph", "layout", "residual"], "component", "value"), "metric", "component")


COMPOSITE = ("quality", "empirical_quality")


@query(f"SELECT metric, metric IN {COMPOSITE} AS is_composite, share, row_number() OVER (ORDER BY metric IN {COMPOSITE}, share DESC, metric) AS place FROM ({_eta()}) WHERE factor = 'graph_id'")
def metrics_by_share(spark, sf):  # noqa: ANN001, ANN201
    """Single scores before composites, those that depend most on the graph first."""
    df = eta2_variance(spark, sf).filter("factor = 'graph_id'").select("metric", F.col("metric").isin(*COMPOSITE).alias("is_composite"), "share")
    return analysis.placed(df, [F.col("is_composite"), F.desc("share"), F.col("metric")])


CUSTOM = ["random", "circular", "spectral", "FMMM", "HOLA"]


@query(f"SELECT layout, n, row_number() OVER (ORDER BY coalesce(list_position({CUSTOM}, layout), 999), layout) AS place FROM (SELECT layout, count(*) AS n FROM metrics GROUP BY 1)")
def layouts_in_custom_order(spark, sf):  # noqa: ANN001, ANN201
    """Layouts in the order of a list, those that it lacks behind it by name."""
    df = table(spark, sf, "metrics").groupBy("layout").agg(F.count("*").alias("n"))
    return analysis.placed(df, [analysis.custom_order(F.col("layout"), CUSTOM), F.col("layout")])


PROPS, SCORES = ["n_nodes", "density", "transitivity", "degree_assortativity", "diameter"], ["kruskal_stress", "node_uniformity", "quality"]


def _spearman(props: list[str], scores: list[str]) -> str:
    parts = []
    for p in props:
        for m in scores:
            parts.append(f"SELECT '{p}' AS x, '{m}' AS y, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0 AS ry FROM pm WHERE {p} IS NOT NULL AND {m} IS NOT NULL) HAVING count(*) >= 30")
    return f"WITH {CLEAN}, {FIRST_SQL}, pm AS MATERIALIZED (SELECT {', '.join(f'{_num(f'g.{p}::DOUBLE')} AS {p}' for p in props)}, {', '.join(f'e.{m}' for m in scores)} FROM (SELECT graph_id, {', '.join(f'round(avg({m}), {FINE}) AS {m}' for m in scores)} FROM q GROUP BY 1) e JOIN graphs g ON e.graph_id = g.graph_id) " + " UNION ALL ".join(parts)


def _means(spark: SparkSession, sf: str, props: list[str], scores: list[str]) -> DataFrame:
    means = clean(spark, sf).groupBy("graph_id").agg(*(F.round(F.avg(m), FINE).alias(m) for m in scores))
    return means.join(graphs(spark, sf).select("graph_id", *(number(F.col(p).cast("double")).alias(p) for p in props)), "graph_id")


@query(_spearman(PROPS, SCORES))
def spearman_property_metric(spark, sf):  # noqa: ANN001, ANN201
    return rounded(analysis.spearman(_means(spark, sf, PROPS, SCORES), PROPS, SCORES), "x", "y", "n")


@query(_spearman(analysis.PROPERTIES, EVERY))
def spearman_all_properties(spark, sf):  # noqa: ANN001, ANN201
    return rounded(analysis.spearman(_means(spark, sf, analysis.PROPERTIES, EVERY), analysis.PROPERTIES, EVERY), "x", "y", "n")


LAYOUTS = ["circular", "random", "spectral", "FMMM", "HOLA"]


@query(f"WITH {CLEAN} SELECT graph_id, {', '.join(f'''round(max(CASE WHEN layout = '{x}' THEN quality END), {FINE}) AS \"{x}\"''' for x in LAYOUTS)} FROM q GROUP BY 1")
def layout_pivot(spark, sf):  # noqa: ANN001, ANN201
    wide = clean(spark, sf).groupBy("graph_id").pivot("layout", LAYOUTS).agg(F.max("quality"))
    return rounded(wide, "graph_id", places=FINE)


FAMILIES = {"force": ["FMMM", "sfdp", "forceatlas2", "drgraph"], "stress": ["stress-majorization", "pivot-MDS", "spectral"], "orthogonal": ["HOLA", "planarization-ortho", "dot-ortho"]}


@query(f"WITH {LAST_SQL} SELECT graph_id, layout, {', '.join(f'(CASE WHEN layout IN ({repr(v)[1:-1]}) THEN 1.0 ELSE 0.0 END)::DOUBLE AS layout_family_{k}' for k, v in FAMILIES.items())} FROM drawn")
def one_hot_family(spark, sf):  # noqa: ANN001, ANN201
    return drawn(spark, sf).select("graph_id", "layout", *(F.when(F.col("layout").isin(v), 1.0).otherwise(0.0).alias(f"layout_family_{k}") for k, v in FAMILIES.items()))


def _bins(props: list[str], scores: list[str], bins: list[int], quantiles: bool) -> str:
    every = sorted({i / b for b in bins for i in range(b + 1)})
    edges = f", list_transform(quantile_cont(vx, {every}), lambda e: e) AS q" if quantiles else ""
    at = f"list_sort(list_distinct(list_transform(range(0, bins + 1), lambda i: q[list_position({every}, i / bins)]))) AS e" if quantiles else "NULL AS e"
    number = "CASE WHEN len(e) > 1 THEN greatest(0, len(list_filter(e, lambda v: v < vx)) - 1) END" if quantiles else "greatest(0, least(bins - 1, ceil(round((vx - lo) / (hi - lo) * bins, 9)) - 1))"
    return f"""WITH {CLEAN}, {FIRST_SQL}, pm AS MATERIALIZED (SELECT e.graph_id, {', '.join(f'{_num(f"g.{p}::DOUBLE")} AS {p}' for p in props)}, {', '.join(f'e.{m}' for m in scores)} FROM (SELECT graph_id, {', '.join(f'round(avg({m}), {FINE}) AS {m}' for m in scores)} FROM q GROUP BY 1) e JOIN graphs g ON e.graph_id = g.graph_id),
      px AS (SELECT graph_id, x, vx FROM (UNPIVOT pm ON {', '.join(props)} INTO NAME x VALUE vx)), py AS (SELECT graph_id, y, vy FROM (UNPIVOT pm ON {', '.join(scores)} INTO NAME y VALUE vy)),
      pairs AS MATERIALIZED (SELECT x, y, vx, vy FROM px JOIN py ON px.graph_id = py.graph_id),
      span AS (SELECT x, y, min(vx) AS lo, max(vx) AS hi, min(vy) AS y_low, max(vy) AS y_high{edges} FROM pairs GROUP BY 1, 2 HAVING count(*) >= 100 AND max(vx) > min(vx)),
      ways AS (SELECT *, {at} FROM span CROSS JOIN (SELECT unnest({bins})::INT AS bins)),
      b AS (SELECT p.x, p.y, bins, vx, vy, y_low, y_high, ({number})::INT AS bin FROM pairs p JOIN ways w ON p.x = w.x AND p.y = w.y)
      SELECT x, y, bins, bin, count(*) AS n, round(quantile_cont(vx, 0.25), 8) + 0.0 AS x_p25, round(quantile_cont(vx, 0.5), 8) + 0.0 AS x_median, round(quantile_cont(vx, 0.75), 8) + 0.0 AS x_p75, round(min(vy), {FINE}) + 0.0 AS y_min, round(quantile_cont(vy, 0.5), 12) + 0.0 AS y_median, round(max(vy), {FINE}) + 0.0 AS y_max, count(*) < 1000 AS low_n, round(min(y_low), {FINE}) + 0.0 AS y_low, round(max(y_high), {FINE}) + 0.0 AS y_high
      FROM b WHERE bin IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10"""


def _binned(spark: SparkSession, sf: str, props: list[str], scores: list[str], bins: list[int], quantiles: bool) -> DataFrame:
    df = analysis.binned(_means(spark, sf, props, scores), props, scores, bins, quantiles)
    places = {c: 8 for c in ("x_p25", "x_median", "x_p75")} | {c: FINE for c in ("y_min", "y_max", "y_low", "y_high")} | {"y_median": 12}
    return df.select(*((F.round(c, places[c]) + 0.0).alias(c) if c in places else c for c in df.columns))


@query(_bins(analysis.PROPERTIES, EVERY, [10], True))
def qcut_bins(spark, sf):  # noqa: ANN001, ANN201
    """Every invariant with every score, ten bins of equal counts."""
    return _binned(spark, sf, analysis.PROPERTIES, EVERY, [10], True)


@query(_bins(analysis.PROPERTIES, EVERY, [10], False))
def cut_bins(spark, sf):  # noqa: ANN001, ANN201
    """Every invariant with every score, ten bins of equal widths."""
    return _binned(spark, sf, analysis.PROPERTIES, EVERY, [10], False)


SWEEP = list(range(3, 11))


@query(_bins(["n_nodes", "density"], ["quality", "kruskal_stress"], SWEEP, True))
def qcut_sweep(spark, sf):  # noqa: ANN001, ANN201
    """Three to ten bins of equal counts."""
    return _binned(spark, sf, ["n_nodes", "density"], ["quality", "kruskal_stress"], SWEEP, True)


@query(_bins(["n_nodes", "density"], ["quality", "kruskal_stress"], SWEEP, False))
def cut_sweep(spark, sf):  # noqa: ANN001, ANN201
    """Three to ten bins of equal widths."""
    return _binned(spark, sf, ["n_nodes", "density"], ["quality", "kruskal_stress"], SWEEP, False)


@query(f"WITH {CLEAN} SELECT {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in Q)}, count(*) AS n FROM q GROUP BY {', '.join(Q)} HAVING count(*) > 1")
def duplicate_vectors(spark, sf):  # noqa: ANN001, ANN201
    return rounded(clean(spark, sf).groupBy(*Q).agg(F.count("*").alias("n")).filter("n > 1"), "n")


@query(f"WITH {FIRST_SQL} SELECT coalesce(category, '(none)') AS category, coalesce(CASE WHEN source <> '' THEN source END, generator, '(none)') AS source, count(*) AS n FROM graphs GROUP BY 1, 2")
def cohort_counts(spark, sf):  # noqa: ANN001, ANN201
    source = F.coalesce(F.when(F.col("source") != "", F.col("source")), "generator", F.lit("(none)"))
    return graphs(spark, sf).groupBy(F.coalesce("category", F.lit("(none)")).alias("category"), source.alias("source")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT count(DISTINCT graph_id) AS n FROM manifest), s AS (SELECT count(DISTINCT dropped_graph_id) AS n FROM sampling_audit), d AS (SELECT count(DISTINCT dropped_graph_id) AS n FROM dedup_audit), l AS (SELECT count(DISTINCT layout) AS n FROM metrics), m AS (SELECT count(DISTINCT (graph_id, layout)) AS n FROM metrics WHERE graph_id IN (SELECT graph_id FROM manifest))
  SELECT unnest(['staged', 'lost_by_sample', 'lost_by_dedup', 'pairs', 'drawings', 'lost_by_filter']) AS step, unnest([g.n, s.n, d.n, g.n * l.n, m.n, g.n * l.n - m.n])::BIGINT AS n, round(unnest([sqrt(g.n), sqrt(s.n), sqrt(d.n), sqrt(g.n * l.n), sqrt(m.n), sqrt(g.n * l.n - m.n)]), 6) AS width FROM g, s, d, l, m""")
def funnel(spark, sf):  # noqa: ANN001, ANN201
    g = table(spark, sf, "manifest").agg(F.countDistinct("graph_id").alias("staged"))
    s = table(spark, sf, "sampling_audit").agg(F.countDistinct("dropped_graph_id").alias("lost_by_sample"))
    d = table(spark, sf, "dedup_audit").agg(F.countDistinct("dropped_graph_id").alias("lost_by_dedup"))
    m = table(spark, sf, "metrics").select("graph_id", "layout")
    n_layouts = m.agg(F.countDistinct("layout").alias("l"))
    drawings = tables.without_orphans(m.distinct(), table(spark, sf, "manifest")).agg(F.count("*").alias("drawings"))
    one = g.crossJoin(s).crossJoin(d).crossJoin(n_layouts).crossJoin(drawings)  # one row each
    steps = {"staged": "staged", "lost_by_sample": "lost_by_sample", "lost_by_dedup": "lost_by_dedup", "pairs": "staged * l", "drawings": "drawings", "lost_by_filter": "staged * l - drawings"}
    long = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.expr(v).alias("n")) for k, v in steps.items()))).alias("x")).select("x.step", "x.n")
    return long.withColumn("width", F.round(F.sqrt("n"), 6))


@query("""WITH a AS (SELECT DISTINCT dropped_graph_id AS id FROM dedup_audit WHERE dropped_graph_id IS NOT NULL), m AS (SELECT id, s.source, row_number() OVER (PARTITION BY id ORDER BY length(s.source) DESC) AS r FROM a JOIN sources s ON starts_with(id, replace(s.source, '/', '_') || '_'))
  SELECT coalesce(m.source, 'unknown') AS source, coalesce(max(s.category), 'real_world') AS category, count(*) AS n FROM a LEFT JOIN m ON a.id = m.id AND r = 1 LEFT JOIN sources s ON m.source = s.source GROUP BY 1""")
def prefix_source_join(spark, sf):  # noqa: ANN001, ANN201
    sources = table(spark, sf, "sources").select("source", "category")
    ids = table(spark, sf, "dedup_audit").select(F.col("dropped_graph_id").alias("graph_id")).filter("graph_id IS NOT NULL").distinct()
    counts = analysis.prefix_source(ids, sources).groupBy("source").agg(F.count("*").alias("n"))
    return counts.join(sources, "source", "left").select("source", F.coalesce("category", F.lit("real_world")).alias("category"), "n")


@query(f"WITH {FIRST_SQL} SELECT split_part(source, '/', 1) AS source, count(*) AS n FROM graphs WHERE source IS NOT NULL GROUP BY 1")
def source_rollup(spark, sf):  # noqa: ANN001, ANN201
    return graphs(spark, sf).filter("source IS NOT NULL").groupBy(F.split_part("source", F.lit("/"), F.lit(1)).alias("source")).agg(F.count("*").alias("n"))


@query("""WITH y AS (SELECT generator, count(*) AS tried, count(*) FILTER (WHERE n_nodes BETWEEN 8 AND 75) AS succeeded FROM manifest WHERE category = 'generated' GROUP BY 1) SELECT generator, tried, succeeded, round(100.0 * succeeded / tried, 6) AS yield_pct, round(succeeded / sum(succeeded) OVER (), 6) AS share FROM y""")
def yield_by_group(spark, sf):  # noqa: ANN001, ANN201
    df = table(spark, sf, "manifest").filter("category = 'generated'")
    return rounded(analysis.yields(df, "generator", F.coalesce(F.col("n_nodes").between(8, 75), F.lit(False))), "generator", "tried", "succeeded")


OUTCOME = "CASE WHEN kruskal_stress IS NULL THEN 'failed' WHEN CAST(kruskal_stress AS VARCHAR(9)) IN ('nan', 'NaN') THEN 'not_applicable' WHEN scored_at IS NULL THEN 'cached' ELSE 'ok' END"


@query(f"SELECT layout, {', '.join(f'''coalesce(count(*) FILTER (WHERE {OUTCOME} = '{o}'), 0) AS {o}''' for o in ('ok', 'cached', 'not_applicable', 'failed'))} FROM metrics GROUP BY 1")
def outcome_pivot(spark, sf):  # noqa: ANN001, ANN201
    df = table(spark, sf, "metrics", raw=True).withColumn("outcome", F.expr(OUTCOME))
    return df.groupBy("layout").pivot("outcome", ["ok", "cached", "not_applicable", "failed"]).count().fillna(0)
