"""A sample that stays the same at every rerun and keeps its members as rows are added.

Graphs have persistent sequence numbers. They fall into blocks of BLOCK numbers, and hashes of a block's number
choose PICKS of its positions before any of them is filled. Whether a graph is chosen thus depends on its own
number only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, is_real

BLOCK, PICKS = 100, 5
#: Numbers of rows by which ranks within a source are cut into pieces.
PIECE = 1 << 16


def chosen(seq: Column, seed: str, extra: Column | None = None, block: int = BLOCK, picks: int = PICKS) -> Column:
    """Whether the position of sequence number seq is among the picks of its block.

    Floyd's way of choosing picks of block positions without repeats, from md5 of seed, extra (a source), the
    block's number and the pick's. Null for a null seq.
    """
    number, place = F.floor(seq / block).cast("long"), F.pmod(seq, F.lit(block))
    head = [F.lit(seed), *([] if extra is None else [extra]), number.cast("string")]

    def drawn(top: int) -> Column:
        digest = F.md5(F.concat_ws("|", *head, F.lit(str(top))))
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(top + 1))

    picked = F.aggregate(
        F.array(*(F.struct(F.lit(t).cast("long").alias("top"), drawn(t).alias("d")) for t in range(block - picks, block))),
        F.array().cast("array<bigint>"), lambda got, x: F.concat(got, F.array(F.when(F.array_contains(got, x.d), x.top).otherwise(x.d))),
    )
    return F.array_contains(picked, place)


def first_rows(manifest: DataFrame) -> DataFrame:
    """(graph_id, run_no, row_id, source) of each graph's first row, by run_no and row_id: rows of later runs never
    change it. source is folded, '(none)' if it isn't real. Rows with a null graph_id, run_no or row_id are left out."""
    source = F.when(is_real(F.col("source")), folded(F.col("source"))).otherwise(F.lit("(none)"))
    rows = manifest.filter("graph_id IS NOT NULL AND run_no IS NOT NULL AND row_id IS NOT NULL")
    first = rows.groupBy("graph_id").agg(F.min(F.struct("run_no", "row_id", source.alias("source"))).alias("f"))
    return first.select("graph_id", "f.run_no", "f.row_id", "f.source")


def stable_sample(manifest: DataFrame, seed: str = "p5") -> DataFrame:
    """(graph_id, seq) of PICKS / BLOCK of the graphs; seq is the row_id of the graph's first row. A filter: what
    is shuffled is only each graph's least row."""
    return first_rows(manifest).select("graph_id", F.col("row_id").alias("seq")).filter(chosen(F.col("seq"), seed))


def stable_sample_by_source(manifest: DataFrame, seed: str = "p5s") -> DataFrame:
    """(source, graph_id, seq) of PICKS / BLOCK of each source's graphs; seq counts the source's graphs from 0 in
    order of first rows, which later rows never renumber.

    Counting goes piece by piece of row numbers, each raised by the count of the pieces before it, so that no task
    orders a whole source.
    """
    first = first_rows(manifest).withColumn("piece", F.floor(F.col("row_id") / PIECE))
    by = ["source", "run_no", "piece"]
    sizes = first.groupBy(*by).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("run_no", "piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("size")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("row_id", "graph_id")) - 1
    numbered = first.withColumn("r", rank).join(starts, by).withColumn("seq", F.col("r") + F.col("before"))
    return numbered.filter(chosen(F.col("seq"), seed, F.col("source"))).select("source", "graph_id", "seq")
