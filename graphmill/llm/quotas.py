"""A sample whose shares follow target proportions, allotted down a tree of categories.

The tree is: all rows, their sources, each source's ranges of n_nodes, and each range's densities (the leaves, one row
of the targets each). What a leaf cannot fill goes first to its siblings (leaves of the same source and range), then
to its cousins (other ranges of the source), then to all others, each time in proportion to what they have to spare.
Leaves draw by permuted dense rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, number
from ..scale import small_or_not
from ..session import materialize

#: One of so many graphs is sampled.
ONE_IN = 20
#: Hexadecimal digits of the permuted order by which a leaf's ranks are cut into pieces.
PIECE = 3
#: From the nearest kin of a leaf to the furthest: what they are called, and the columns in which they agree with it.
KIN = {"siblings": ["__s", "n_lo", "n_hi"], "cousins": ["__s"], "others": []}


def memberships(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (target_id, graph_id): graphs with a manifest row in the stratum of a target. Rows with a null
    graph_id, source, n_nodes or density, or NaN, are in none."""
    rows = manifest.select("graph_id", folded(F.col("source")).alias("__s"), "n_nodes", number(F.col("density")).alias("density")).filter("graph_id IS NOT NULL")
    strata = targets.select("target_id", folded(F.col("source")).alias("__s"), "n_lo", "n_hi", "density_lo", "density_hi")
    met = rows.join(small_or_not(strata), "__s").filter("n_nodes BETWEEN n_lo AND n_hi AND density >= density_lo AND density < density_hi")
    return met.select("target_id", "graph_id").distinct()


def wanted(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with want = max(floor_rows, floor(target_share * S + 0.5)), S = floor(different graphs / ONE_IN).
    A null share or floor counts as 0."""
    size = manifest.agg(F.floor(F.countDistinct("graph_id") / ONE_IN).alias("__size"))
    share = F.floor(F.coalesce("target_share", F.lit(0.0)) * F.col("__size") + 0.5)
    return targets.crossJoin(F.broadcast(size)).withColumn("want", F.greatest(F.coalesce("floor_rows", F.lit(0)), share).cast("long")).drop("__size")


def unmet(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id of the leaves that passed on some of what they want, or left it unfilled, because their stratum has fewer
    graphs; a graph counts in each stratum in which it has a row."""
    short = " + ".join([*(f"to_{kin}" for kin in KIN), "unfilled"])
    return allotted(manifest, targets).filter(f"{short} > 0 AND available < want").select("target_id")


def allotted(manifest: DataFrame, targets: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """For each target: want; available (graphs with a row in its stratum) and drawable (those of them that no
    target of smaller id has); own rows; from_* and to_*: rows taken over from, and passed on to, kin of each degree;
    allotted = own + all from_*; short = want - own = all to_* + unfilled; met (available >= want).

    The windows run over the targets, one row each, not over the manifest.
    """
    members = materialize(memberships(manifest, targets)) if members is None else members
    available = members.groupBy("target_id").agg(F.count("*").alias("available"))
    drawable = members.groupBy("graph_id").agg(F.min("target_id").alias("target_id")).groupBy("target_id").agg(F.count("*").alias("drawable"))
    df = wanted(manifest, targets).withColumn("__s", F.coalesce(folded(F.col("source")), F.lit(""))).join(available, "target_id", "left").join(drawable, "target_id", "left").fillna(0, ["available", "drawable"])
    df = df.withColumn("own", F.least("want", "drawable")).withColumns({"short": F.col("want") - F.col("own"), "unfilled": F.col("want") - F.col("own"), "__spare": F.col("drawable") - F.col("own")})
    for kin, same in KIN.items():
        all_of = Window.partitionBy(*same) if same else Window.partitionBy()
        upto = all_of.orderBy("__s", "target_id").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"__{k}_{c}": F.sum(c).over(w) for c in ("unfilled", "__spare") for k, w in (("all", all_of), ("upto", upto))})
        df = df.withColumn("__moved", F.least("__all_unfilled", "__all___spare"))
        for out, c in ((f"from_{kin}", "__spare"), (f"to_{kin}", "unfilled")):  # whole numbers by cumulated shares: no leaf's is more than its c
            piece = F.expr(f"(__upto_{c} * __moved) div __all_{c} - ((__upto_{c} - {c}) * __moved) div __all_{c}")
            df = df.withColumn(out, F.when(F.col(f"__all_{c}") > 0, piece).otherwise(F.lit(0)).cast("long"))
        df = df.withColumns({"__spare": F.col("__spare") - F.col(f"from_{kin}"), "unfilled": F.col("unfilled") - F.col(f"to_{kin}")})
    taken = [f"from_{kin}" for kin in KIN]
    total = sum((F.col(c) for c in taken), F.col("own"))
    return df.select("target_id", "source", "want", "available", "drawable", "own", *taken, total.alias("allotted"), "short", *(f"to_{kin}" for kin in KIN), "unfilled", (F.col("available") >= F.col("want")).alias("met"))


def sample(manifest: DataFrame, targets: DataFrame, seed: str = "p4") -> DataFrame:
    """(target_id, graph_id): of each leaf the graphs whose dense rank in a permuted order (md5 of seed and id) is
    within its allotment. A graph in several strata is drawn, if at all, for that of smallest target_id.

    Ranks are taken piece by piece of the permuted order and raised by the count of the pieces before, so no task
    ranks a whole leaf; pieces behind the allotment are dropped before they are shuffled.
    """
    members = materialize(memberships(manifest, targets))
    graphs = members.groupBy("graph_id").agg(F.min("target_id").alias("target_id")).withColumn("h", F.md5(F.concat(F.lit(seed + "|"), "graph_id"))).withColumn("piece", F.substring("h", 1, PIECE))
    sizes = graphs.groupBy("target_id", "piece").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("target_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leaves = materialize(allotted(manifest, targets, members).select("target_id", "allotted"))
    open_pieces = materialize(sizes.withColumn("before", before).join(small_or_not(leaves), "target_id").filter("before < allotted").drop("size"))
    rank = F.dense_rank().over(Window.partitionBy("target_id", "piece").orderBy("h")) + F.col("before")
    return graphs.join(small_or_not(open_pieces), ["target_id", "piece"]).withColumn("r", rank).filter("r <= allotted").select("target_id", "graph_id")
