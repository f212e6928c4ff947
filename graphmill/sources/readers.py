"""Scans: graph files of any registered format, the corpus tables, logs, and the staging of a source.

Fetching is left to whatever copies files into a folder; everything here reads folders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..operators import corpus
from ..session import materialize
from . import formats

GRAPH = "path string, name string, n int, us array<int>, vs array<int>, orig_ids array<string>, xs array<double>, ys array<double>, attrs array<map<string,string>>, paths array<string>, bends array<array<struct<x:double,y:double>>>, connected boolean, problem string"
#: Nodes and edges of parsed graphs that are handed on together.
BLOCK = 20_000
#: Columns of the manifest in their order.
MANIFEST = T.StructType([
    T.StructField(n, t) for n, t in [
        ("graph_id", T.StringType()), ("generator", T.StringType()), ("category", T.StringType()), ("source", T.StringType()), ("seed", T.LongType()), ("params_json", T.StringType()), ("n_nodes", T.IntegerType()), ("n_edges", T.IntegerType()),
        ("density", T.DoubleType()), *((c, T.BooleanType()) for c in ("is_bipartite", "is_planar", "is_tree", "is_forest", "is_regular", "is_eulerian")), ("min_degree", T.IntegerType()), ("max_degree", T.IntegerType()),
        *((c, T.DoubleType()) for c in ("mean_degree", "degree_std", "diameter", "radius", "avg_shortest_path_length")), ("n_triangles", T.LongType()), *((c, T.DoubleType()) for c in ("average_clustering", "transitivity", "degree_assortativity")),
        ("n_biconnected_components", T.IntegerType()), ("degeneracy", T.IntegerType()), ("crossing_number_lb_euler", T.IntegerType()), ("crossing_number_lb_bipartite", T.DoubleType()), ("generated_at_utc", T.TimestampType()),
    ]
])
CATEGORIES = ("generated", "calibration", "benchmark", "real_world", "graphs_with_drawings")
NESTED = ("benchmark", "real_world", "graphs_with_drawings")


def read_graphs(spark: SparkSession, path: str, fmt: str, drawn: bool = False, pattern: str = "*") -> DataFrame:
    """The graphs of all files under path in a registered format; one row each, or one with a problem for a file without any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parse_files(files, fmt, drawn)


def parse_files(files: DataFrame, fmt: str, drawn: bool = False) -> DataFrame:
    """read_graphs of a table (path, content)."""
    schema = T._parse_datatype_string(GRAPH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contents = ((r.path, bytes(r.content)) for b in batches for r in b.itertuples(index=False))
        return parsed(contents, fmt, drawn, schema.names)

    return files.mapInPandas(run, schema)


def parsed(contents: Iterator[tuple[str, bytes]], fmt: str, drawn: bool, names: list[str]) -> Iterator[pd.DataFrame]:
    """Columns names of read_graphs of files (path, content), in blocks of BLOCK nodes and edges or little more. A file is asked
    for when those before it are parsed, so no more than a block is in memory."""
    rows, held = [], 0
    for path, content in contents:
        for x in _of_file(path, content, fmt, drawn):
            rows.append([x.get(c) for c in names])
            held += 1 + x.get("n", 0) + len(x.get("us", ()))
            if held >= BLOCK:
                yield pd.DataFrame(rows, columns=names, dtype=object)
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names, dtype=object)


def _of_file(path: str, content: bytes, fmt: str, drawn: bool) -> Iterator[dict]:
    try:
        for raw in formats.PARSERS[fmt](path, content):
            g = formats.canonical(raw, drawn)
            one = kernels.n_components(g["n"], np.asarray(g["us"], np.int64), np.asarray(g["vs"], np.int64)) == 1 if g["n"] else False
            yield {"path": path, "connected": one, **g}
    except formats.Skip as e:
        yield {"path": path, "problem": str(e)}
    except Exception as e:  # noqa: BLE001
        yield {"path": path, "problem": f"read_error({type(e).__name__})"}


def stage(graphs: DataFrame, source: str, category: str, known: DataFrame | None = None, cap: int = 0, n_min: int | None = None, n_max: int = corpus.N_MAX, density_cap: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, reasons): graphs of one source that pass all filters and aren't known yet, the first cap of them by id, and
    how many rows each reason took. Known ids are counted as already_in_manifest before any filter. Graphs are parsed and
    judged once, into a table that both results are read from."""
    suffix = ".geg" if category == "graphs_with_drawings" else ".graphml"
    ids = F.concat(F.regexp_replace(F.lit(source), "/", "_"), F.lit("_"), F.col("name"), F.lit(suffix))
    df = graphs.withColumn("graph_id", ids).withColumns({"source": F.lit(source), "category": F.lit(category)})
    low = n_min if n_min is not None else corpus.FLOOR if category in ("real_world", "benchmark") else corpus.N_MIN
    why = corpus.reject_reason(F.col("n"), F.size("us"), F.coalesce("connected", F.lit(False)), low, n_max, None if density_cap is None else F.lit(density_cap))
    reason = F.coalesce(F.substring_index("problem", "(", 1), why)
    if known is not None:
        marks = known.select(F.col("graph_id").alias("__id"), F.lit("already_in_manifest").alias("__known")).filter("__id IS NOT NULL").distinct()
        df = df.join(marks, F.col("graph_id") == F.col("__id"), "left").drop("__id")
        reason = F.coalesce("__known", reason)
    df = materialize(df.withColumn("reason", reason).drop("__known"))
    kept = corpus.first_accepted(df.filter("reason IS NULL"), ["source"], [F.col("graph_id")], cap)
    reasons = df.groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
    return kept.drop("reason", "problem"), reasons


def catalogue(records: DataFrame) -> DataFrame:
    """Pages of a catalogue of networks, as paged_json has them (id or name of the entry, json), as rows of promising(): one
    for an entry with one network, one for each network of an entry with several (its analyses are keyed by their names).
    (entry, network, num_vertices, num_edges, is_directed, edge_reciprocity, largest_component_fraction); restricted entries
    are left out. A network's file-safe name has _ for / : and backslash."""
    one = "num_vertices long, num_edges long, is_directed boolean, edge_reciprocity double, largest_component_fraction double"
    whole = F.from_json("json", "restricted boolean, nets array<string>, analyses string")
    df = records.select(F.col("id").alias("entry"), whole.alias("r")).filter(~F.coalesce("r.restricted", F.lit(False)))
    single = F.from_json("r.analyses", one)
    named = F.from_json("r.analyses", f"map<string, struct<{', '.join(f.replace(' ', ':', 1) for f in one.split(', '))}>>")
    alone = df.select("entry", F.col("entry").alias("network"), single.alias("a")).filter("a.num_vertices IS NOT NULL")
    several = df.filter(single["num_vertices"].isNull()).select("entry", F.explode_outer("r.nets").alias("network"), named.alias("m")).filter("network IS NOT NULL")
    several = several.select("entry", "network", F.element_at("m", F.col("network")).alias("a"))
    return alone.unionByName(several).select("entry", "network", F.translate("network", "/:\\", "___").alias("safe_name"), "a.*")


def adjacency_graphs(records: DataFrame) -> DataFrame:
    """Pages of graphs as adjacency lists (paged_json) as staged graphs: each record once, by id."""
    from .paged import first_of_each

    files = first_of_each(records, None).select(F.concat(F.lit("page/"), F.col("id"), F.lit(".json")).alias("path"), F.col("json").cast("binary").alias("content"))
    return parse_files(files, "adjacency_json")


def open_networks(records: DataFrame, most: int = 200) -> DataFrame:
    """Pages of networks in CX (paged_json; json is the network's list of aspects) as staged drawings: each id once, those whose
    licence is open, the first most of them by page and place (the feature: a source's limit)."""
    from .paged import first_of_each

    rights = F.from_json("json", "array<struct<networkAttributes:array<struct<n:string,v:string>>>>")
    named = lambda k: F.try_element_at(F.transform(F.filter(F.flatten(F.coalesce(F.transform(F.filter(rights, lambda a: a["networkAttributes"].isNotNull()), lambda a: a["networkAttributes"]), F.array())), lambda x: F.lower(F.trim(x["n"])) == k), lambda x: x["v"]), F.lit(1))
    usable = records.filter(is_open(named("rights")))
    files = first_of_each(usable, most).select(F.concat(F.lit("page/"), F.col("id"), F.lit(".cx")).alias("path"), F.col("json").cast("binary").alias("content"))
    return parse_files(files, "cx", drawn=True)


def routes_by_country(airports: DataFrame, routes: DataFrame) -> DataFrame:
    """edges(graph_id, u, v): undirected routes between airports of one country; airports(id, country), routes(src, dst)."""
    from ..scale import skew_join

    a = airports.select(F.col("id"), "country").filter("id IS NOT NULL").dropDuplicates(["id"])
    both = skew_join(routes, a.withColumnsRenamed({"id": "src", "country": "c1"}), ["src"])
    both = skew_join(both, a.withColumnsRenamed({"id": "dst", "country": "c2"}), ["dst"])
    same = both.filter("c1 = c2 AND src <> dst").select(F.col("c1").alias("graph_id"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return same.distinct()


def estimated_density(n: Column, m: Column, directed: Column, reciprocity: Column) -> Column:
    """Density of a network without directions, from its metadata: directed edges count less by half the reciprocity, or by
    a quarter where it isn't known. Null below two nodes."""
    edges = F.when(directed & reciprocity.isNotNull(), m * (1 - reciprocity / 2)).when(directed, m * 0.75).otherwise(m)
    return F.when(n >= 2, edges / (n * (n - 1) / 2))


def promising(catalogue: DataFrame, n_min: int = corpus.FLOOR, n_max: int = corpus.N_MAX) -> DataFrame:
    """Networks of a catalogue (num_vertices, num_edges, is_directed, edge_reciprocity, largest_component_fraction) worth
    fetching: by size, connection and estimated density."""
    n, m = F.col("num_vertices"), F.col("num_edges")
    dense = estimated_density(n, m, F.coalesce("is_directed", F.lit(False)), F.col("edge_reciprocity"))
    return catalogue.filter(n.between(n_min, n_max) & m.isNotNull() & (F.coalesce("largest_component_fraction", F.lit(1.0)) >= 1) & (F.coalesce(dense, F.lit(0.0)) <= corpus.density_cap(n)))


def is_open(rights: Column) -> Column:
    """Whether a licence text is open: it isn't empty, has no closing word and has an opening one."""
    low = F.lower(F.coalesce(rights, F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return ~any_of(formats.CLOSED) & any_of(formats.OPEN)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest in CSV, by its fixed schema; columns it lacks are null, nan is null."""
    df = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    cols = {c.lower(): c for c in df.columns}

    def typed(f: T.StructField) -> Column:
        if f.name not in cols:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.col(f"`{cols[f.name]}`")
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            return text.try_cast("double").cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            x = text.try_cast("double")
            return F.when(~F.isnan(x), x).alias(f.name)
        return (text.try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else text).alias(f.name)

    return df.select(*(typed(f) for f in MANIFEST))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """One CSV for each layout, below one another, with the layout from the file's name."""
    df = spark.read.option("header", "true").csv(path + "/*.csv")
    layout = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    flags = [c for c in df.columns if c.startswith("contains_")]
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")).alias(c)
    return df.select("graph_id", layout.alias("layout"), *(F.col(c).try_cast("boolean").alias(c) if c in flags else number(c) for c in df.columns if c != "graph_id"))


def list_drawings(spark: SparkSession, path: str) -> DataFrame:
    """(layout, category, source, name, path) of the drawings under path: layout/category[/source...]/name.svg."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split(F.regexp_replace("path", r"^.*?\Q" + re.sub(r"^\w+:/+", "/", path).rstrip("/") + r"/\E", ""), "/")
    return files.select(F.element_at(parts, 1).alias("layout"), F.element_at(parts, 2).alias("category"), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), "/").alias("source"), F.regexp_replace(F.element_at(parts, -1), r"\.svg$", "").alias("name"), "path")


def log_totals(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(reason, n): sums over sources of the counts in the last line "[source] kept=N reasons={...}" of each.
    lines(value, order)."""
    pattern = r"^\[([^\]]+)\] kept=[\d,]+\s+reasons=(\{[^}]*\})"
    hit = lines.filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("source"), F.translate(F.regexp_extract("value", pattern, 2), "'", '"').alias("json"), order)
    last = hit.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(order)))).filter("r = 1")
    counts = last.select(F.explode(F.from_json("json", "map<string,bigint>")).alias("reason", "n"))
    return counts.groupBy("reason").agg(F.sum("n").alias("n"))


def load_corpus(spark: SparkSession, folder: str, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(drawings, envelopes) of a corpus folder with manifest.csv and metrics/<layout>.csv: every drawing with its graph's row, and
    for each graph n_drawings, min, max and range of each metric, with the same row."""
    manifest = read_manifest(spark, f"{folder}/manifest.csv")
    drawings = read_scores(spark, f"{folder}/metrics").join(manifest, "graph_id", "left")
    stats = [x for m in metrics for x in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), (F.max(m) - F.min(m)).alias(f"{m}_range"))]
    return drawings, drawings.groupBy("graph_id").agg(F.count("*").alias("n_drawings"), *stats).join(manifest, "graph_id", "left")
