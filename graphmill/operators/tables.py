"""Upkeep of the corpus tables: resuming, reconciling, sampling, removing duplicates, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number
from ..scale import exact_percentiles, hashed_rank, null_safe, skew_join, small_or_not
from ..session import materialize

#: Quantile bins by which a source is stratified, for each of n_nodes and density.
BINS = 5


def known_ids(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-null ids that any of the tables has in its column."""
    return reduce(DataFrame.unionByName, (df.select(F.col(c).alias("graph_id")) for df, c in tables)).filter("graph_id IS NOT NULL").distinct()


def not_done(candidates: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Candidates that done hasn't; those with a null key are all not done."""
    return candidates.join(done.select(*on).distinct(), on, "left_anti")


def without_orphans(scores: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of scores whose graph the manifest has."""
    return scores.join(manifest.select("graph_id").distinct(), "graph_id", "left_semi")


def last_writes(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in order (give the latest first). Each task keeps one row of a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_ids(df: DataFrame, k: int) -> DataFrame:
    """(category, group, graph_id): of each cohort and source (or generator) the k smallest ids."""
    group = F.coalesce(F.when(F.trim("source") != "", F.col("source")), F.col("generator"))
    ids = df.select("category", group.alias("group"), "graph_id").distinct()
    return ids.withColumn("__n", F.row_number().over(Window.partitionBy("category", "group").orderBy("graph_id"))).filter(F.col("__n") <= k).drop("__n")


def quantile_bin(x: Column, edges: Column) -> Column:
    """The number of the right-closed bin of x between edges (sorted, distinct), from 0; null for a null x or a single edge."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNotNull() & (F.size(edges) > 1), F.greatest(F.lit(0), below - 1))


def edges_of(q: Column) -> Column:
    """Bin edges from percentiles in order: each once."""
    return F.array_distinct(q)


def strata(df: DataFrame, by: str = "source") -> DataFrame:
    """df with stratum "i_j": the quintiles of n_nodes and density within by (a null by is a group too); "<NA>" for a column
    without two edges."""
    d = number(F.col("density"))
    qs = [i / BINS for i in range(BINS + 1)]
    long = df.select(F.col(by).alias("__by"), F.explode(F.array(F.struct(F.lit("n").alias("c"), F.col("n_nodes").cast("double").alias("x")), F.struct(F.lit("d").alias("c"), d.alias("x")))).alias("v")).select("__by", "v.c", "v.x")
    found = exact_percentiles(long, ["__by", "c"], "x", qs)
    edges = found.groupBy("__by").agg(*(F.max(F.when(F.col("c") == c, edges_of(F.col("q")))).alias(f"__{c}") for c in "nd"))
    known = df.select(F.col(by).alias("__all")).distinct().join(edges, F.col("__all").eqNullSafe(F.col("__by")), "left").drop("__by")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("<NA>"))
    out = df.join(small_or_not(known), F.col(by).eqNullSafe(F.col("__all"))).withColumn("stratum", F.concat_ws("_", name(quantile_bin(F.col("n_nodes"), F.col("__n"))), name(quantile_bin(d, F.col("__d")))))
    return out.drop("__n", "__d", "__all")


def allotment(counts: DataFrame, by: str, cap: Column) -> DataFrame:
    """counts(by, stratum, n) with quota: how many rows each stratum of a by keeps if by keeps cap of them.

    Every stratum begins with its share of cap, half to even, at least 1 and at most all. What this is above cap is taken
    away one by one where most stands above the share (of strata with more than one row first), what it lacks is given one by
    one where most rows are left; ties go to the first name. The ones are numbered and ranked, so the rounds are one
    window over no more than strata times the difference, which strata bound. A by of no more rows than cap, or with a
    cap of null or 0, is kept whole.
    """
    whole = Window.partitionBy(by)
    d = counts.withColumn("__cap", cap).withColumn("__all", F.sum("n").over(whole))
    free = F.coalesce(F.col("__cap"), F.lit(0)) == 0
    d = d.withColumn("__cap", F.when(free | (F.col("__all") <= F.col("__cap")), F.col("__all")).otherwise(F.col("__cap")))
    d = d.withColumn("__share", F.bround(F.col("n") * F.col("__cap") / F.col("__all")).cast("long"))
    d = d.withColumn("__own", F.least(F.greatest("__share", F.lit(1)), F.col("n"))).withColumn("__over", F.sum("__own").over(whole) - F.col("__cap"))
    least = F.least(F.when(F.col("__over") > 0, F.col("__own")).otherwise(F.col("n") - F.col("__own")), F.abs("__over"))
    ones = d.filter(least > 0).select(by, "stratum", "n", "__own", "__share", "__over", F.explode(F.sequence(F.lit(1).cast("long"), least)).alias("u"))
    away = F.col("__over") > 0
    last = away & (F.col("u") == F.col("__own"))  # would leave nothing
    want = F.when(away, F.col("__own") - F.col("__share")).otherwise(F.col("n") - F.col("__own")) - F.col("u")
    ranked = ones.withColumn("__r", F.row_number().over(whole.orderBy(last, F.desc(want), "stratum"))).filter(F.col("__r") <= F.abs("__over"))
    moved = ranked.groupBy(F.col(by).alias("__b"), F.col("stratum").alias("__s")).agg(F.count("*").alias("__moved"))
    out = d.join(moved, null_safe([by, "stratum"], ["__b", "__s"]), "left")
    return out.select(by, "stratum", "n", (F.col("__own") - F.signum("__over").cast("long") * F.coalesce("__moved", F.lit(0))).alias("quota"))


def stratified_sample(df: DataFrame, cap: int | dict[str, int], seed: str = "sample", by: str = "source", key: str = "graph_id") -> DataFrame:
    """Rows of df of which each by keeps at most cap (a number, or one by name; none for a name that isn't there, or 0),
    spread over its strata; a by of no more rows is kept whole.

    Within a stratum the rows of least md5(seed|by|key) stay, so one source's rows don't depend on another's. A null by is a
    group like any other. The allotment works on counts (25 for a source).
    """
    marked = strata(df, by)
    counts = materialize(marked.groupBy(by, "stratum").agg(F.count("*").alias("n")))
    most = F.lit(cap) if isinstance(cap, int) else F.element_at(F.create_map(*(F.lit(x) for kv in cap.items() for x in kv)), F.col(by)) if cap else F.lit(None)
    quota = allotment(counts, by, most.cast("long")).select(F.col(by).alias("__b"), F.col("stratum").alias("__s"), "quota")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(by), F.col(key)))
    ranked = hashed_rank(marked.withColumn("__h", order), [by, "stratum"], "__h", "__n")
    return ranked.join(small_or_not(materialize(quota)), null_safe([by, "stratum"], ["__b", "__s"])).filter("__n <= quota").drop("__n", "__h", "quota", "stratum", "__b", "__s")


def tier(category: Column, generator: Column, source: Column) -> Column:
    """0 for graphs that are never dropped, 1 for named collections, 2 for bulk."""
    named = (category == "benchmark") | (source == "houseofgraphs") | F.startswith(source, F.lit("netzschleuder"))
    return F.when((category == "graphs_with_drawings") | (generator == "exhaustive_small"), 0).when(F.coalesce(named, F.lit(False)), 1).otherwise(2)



def with_source_size(df: DataFrame) -> DataFrame:
    """df with source_size: the number of rows of its source; rows without a source are one source."""
    named = df.withColumn("__s", F.coalesce("source", F.lit("(none)")))
    sizes = named.groupBy("__s").agg(F.count("*").alias("source_size"))
    return skew_join(named, sizes, ["__s"]).drop("__s")


def duplicates(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """df with class_size, and the graph, source and category that its class keeps (kept_*): the first in rank.

    df has one row for each graph; null keys are equal. Two aggregates by the class key take the place of a window, so
    a class of any size is combined within the tasks first.
    """
    kept = df.groupBy(*keys).agg(F.count("*").alias("class_size"), F.min_by(F.struct(*(F.col(c).alias(f"kept_{c}") for c in ("graph_id", "source", "category"))), F.struct(*rank)).alias("__k"))
    match = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return df.alias("l").join(kept.alias("r"), match).select("l.*", "class_size", "__k.*")


def dedup_audit(df: DataFrame) -> DataFrame:
    """The audit of what duplicates() drops: all but the kept graph of a class, and never tier 0."""
    lost = df.filter("class_size > 1 AND graph_id <> kept_graph_id AND tier <> 0")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    scope = F.when(text("source") == text("kept_source"), "within-source").otherwise("cross-source")
    return lost.select(F.col("graph_id").alias("dropped_graph_id"), F.col("source").alias("dropped_source"), F.col("category").alias("dropped_category"), "kept_graph_id", "kept_source", "kept_category", F.col("class_size").alias("iso_class_size"), scope.alias("scope"))
