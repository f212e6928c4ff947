"""The best representative of each group of duplicate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, is_real
from ..scale import small_or_not

FIELDS = ["category", "source", "generator"]


def scored(df: DataFrame, sources: DataFrame, fields: list[str] = FIELDS, at: str = "generated_at_utc") -> DataFrame:
    """df with n_real (how many of fields hold a value), trust (of the row's source; 0 without one) and
    recency (microseconds of at; the least number for null). A source listed twice has its highest trust."""
    trusts = sources.select(folded(F.col("source")).alias("__src"), F.coalesce("trust", F.lit(0)).cast("int").alias("trust")).filter("__src IS NOT NULL").groupBy("__src").agg(F.max("trust").alias("trust"))
    out = df.withColumns({
        "n_real": sum((is_real(F.col(c)).cast("int") for c in fields), F.lit(0)),
        "recency": F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**63)).cast("long")),
        "__src": F.when(is_real(F.col("source")), folded(F.col("source"))),
    })
    return out.drop("trust").join(small_or_not(trusts), "__src", "left").withColumn("trust", F.coalesce("trust", F.lit(0))).drop("__src")


def _rank() -> list[Column]:
    return [F.desc("n_real"), F.desc("trust"), F.desc("recency"), F.asc("row_id")]


def top_rows(df: DataFrame, key: str = "prop_hash") -> DataFrame:
    """Of each group of equal non-null key, the row with most real fields, then highest trust, then latest;
    ties go to the smallest row_id. Spark ranks within every input task first (WindowGroupLimit), so of a group
    of any size each task sends one row."""
    w = Window.partitionBy(key).orderBy(*_rank())
    return df.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def group_bests(df: DataFrame, key: str = "prop_hash") -> DataFrame:
    """For each group: n_rows, the best of each measure, and how many rows share the measures of the top row."""
    same = df.filter(F.col(key).isNotNull()).groupBy(key, "n_real", "trust", "recency").agg(F.count("*").alias("n"))
    order = F.struct("n_real", "trust", "recency")
    return same.groupBy(key).agg(
        F.sum("n").alias("n_rows"), F.max("n_real").alias("best_real"), F.max("trust").alias("best_trust"),
        F.max("recency").alias("best_recency"), F.max_by("n", order).alias("n_top"),
    )


def clear_winners(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """(prop_hash, row_id) of the groups of two or more rows in which the top row, and no other, has the best
    of every measure. A group with several such rows, or with none, gives no row."""
    df = scored(manifest.select("prop_hash", "row_id", "generated_at_utc", *FIELDS), sources)
    top = top_rows(df.select("prop_hash", "row_id", "n_real", "trust", "recency"))
    best = group_bests(df).filter("n_rows > 1 AND n_top = 1")
    return top.join(best, "prop_hash").filter("n_real = best_real AND trust = best_trust AND recency = best_recency").select("prop_hash", "row_id")


def survivors(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each graph: the top row of its group, each of whose fields that holds no value is filled from
    the most trusted, then latest row that has one (ties: smallest row_id); null if no row has one.

    Rows without a key match nothing and stay, one by one. Columns: prop_hash, row_id, graph_id, category,
    source, generator, n_rows.
    """
    cols = ["prop_hash", "row_id", "graph_id", *FIELDS, "n_real", "trust", "recency"]
    df = scored(manifest.select("prop_hash", "row_id", "graph_id", "generated_at_utc", *FIELDS), sources).select(*cols)
    order = F.struct("trust", "recency", -F.col("row_id"))
    names = ["graph_id", *FIELDS]
    filled = df.filter("prop_hash IS NOT NULL").groupBy("prop_hash").agg(F.count("*").alias("n_rows"), *(F.max_by(F.when(is_real(F.col(c)), F.col(c)), F.when(is_real(F.col(c)), order)).alias(f"__{c}") for c in names))
    built = top_rows(df).join(filled, "prop_hash").select("prop_hash", "row_id", *(F.when(is_real(F.col(c)), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in names), "n_rows")
    alone = df.filter("prop_hash IS NULL").select("prop_hash", "row_id", *(F.when(is_real(F.col(c)), F.col(c)).alias(c) for c in names), F.lit(1).cast("long").alias("n_rows"))
    return built.unionByName(alone)
