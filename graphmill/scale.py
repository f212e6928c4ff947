"""Joins whose hot keys and small sides are found by counting, not by trust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side with at most so many rows may be broadcast.
BROADCAST_ROWS = 200_000
#: A key with fewer rows than this is never hot, and a table of fewer rows has no hot key.
HOT_ROWS = 200_000
#: A hot key holds more than this share of the rows, so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3
#: Parts into which hot keys are cut where the other side may have many rows of them too.
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if its rows, counted now, are few; else as it is."""
    return F.broadcast(df) if is_small(df, rows) else df


def hot_keys(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame | None:
    """The keys that hold more than HOT_SHARE of df's rows, or None if df is too small for any."""
    n = df.count() if n is None else n
    if n < HOT_ROWS:
        return None
    return df.groupBy(*keys).count().filter(F.col("count") > max(HOT_ROWS, n * HOT_SHARE)).drop("count")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", n: int | None = None) -> DataFrame:
    """left join right, where a few keys may hold a large share of left's rows and right has one row for each key.

    The rows of hot keys meet a broadcast of their right rows (fewer than 1 / HOT_SHARE of them, by the definition of
    hot); all others are shuffled. how: inner or left. n: left's number of rows, if it is known. Null keys match nothing.
    """
    hot = hot_keys(left, keys, n)
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    cold = left.join(hot, keys, "left_anti").join(right, keys, how)
    heated = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return cold.unionByName(heated)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of two sides, either of which may have many rows of some keys.

    A key that is hot on one side is cut there into SALTS parts, each of which meets a copy of the other side's rows of
    that key; hot on both, the left side is cut. All other rows are shuffled by key. Give tables that are cheap to read
    again. Null keys match nothing.
    """
    hot_left, hot_right = hot_keys(left, keys), hot_keys(right, keys)
    if hot_left is None and hot_right is None:
        return left.join(right, keys)
    parts, names = [], [*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys)]
    for hot, cut_left in ((hot_left, True), (hot_right, False)):
        if hot is None:
            continue
        mark = F.broadcast(hot)
        big, other = (left, right) if cut_left else (right, left)
        values = [c for c in big.columns if c not in keys]
        part = F.pmod(F.xxhash64(*values), F.lit(SALTS)).cast("int") if values else F.lit(0)
        cut = big.join(mark, keys, "left_semi").withColumn("__part", part)
        copies = other.join(mark, keys, "left_semi").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts.append(cut.join(copies, [*keys, "__part"]).select(*names))
        left, right = left.join(mark, keys, "left_anti"), right.join(mark, keys, "left_anti")
    out = left.join(right, keys).select(*names)
    for p in parts:
        out = out.unionByName(p)
    return out


def hashed_rank(df: DataFrame, by: list[str], digest: str, out: str, digits: int = 2) -> DataFrame:
    """df with out: the rank from 1 of each row within by in the order of digest, a column of hexadecimal text.

    Ranks are taken among the rows whose digest begins with the same digits and raised by the number of rows before, so
    a group of any size is ranked by 16 ** digits tasks. Null by and equal digests are ranked like any others.
    """
    df = df.withColumn("__piece", F.substring(digest, 1, digits))
    sizes = df.groupBy(*by, "__piece").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__piece").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "__piece").orderBy(digest)))
    same = F.col("__piece") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return ranked.join(starts, same).withColumn(out, F.col("__rank") + F.col("__before")).drop("__piece", "__rank", "__p", "__before", *(f"__by{i}" for i in range(len(by))))


def null_safe(left: list[str], right: list[str]) -> Column:
    """Whether columns are equal one by one, nulls too."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def _piece(v: Column) -> Column:
    """A number that grows with v, with 64 steps for every doubling."""
    size = F.floor(F.greatest(F.least(F.log2(F.abs(v)), F.lit(1100.0)), F.lit(-1100.0)) * 64) + 80_000
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def in_order(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """counts(by, value, n, ...), one row for each value of by, with before: the sum of n of by's smaller values; and rows: the
    sum of all. value is a number, neither null nor NaN. Null by is a group like any other.

    Values are cut into pieces by their size; sums run within a piece and are raised by those of the pieces before, so a
    group of any size is spread over many tasks.
    """
    cut = counts.withColumn("__piece", _piece(F.col(value).cast("double")))
    sizes = cut.groupBy(*by, "__piece").agg(F.sum("n").alias("__size"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumns({"__start": F.coalesce(F.sum("__size").over(upto(Window.partitionBy(*by).orderBy("__piece"))), F.lit(0)), "rows": F.sum("__size").over(Window.partitionBy(*by))})
    starts = starts.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__piece").alias("__p"), "__start", "rows")
    inner = F.coalesce(F.sum("n").over(upto(Window.partitionBy(*by, "__piece").orderBy(value))), F.lit(0))
    met = cut.withColumn("__inner", inner).join(starts, null_safe([*by, "__piece"], [*(f"__by{i}" for i in range(len(by))), "__p"]))
    return met.select(*counts.columns, (F.col("__inner") + F.col("__start")).alias("before"), "rows")


def ordered_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, before, rows): how many rows each value has within by, how many rows of by have smaller values, and how
    many by has. Values are counted within the tasks first, so one with many rows is no burden."""
    return in_order(df.groupBy(*by, value).agg(F.count("*").alias("n")), by, value)


def exact_percentiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """(by, rows, q): the number of rows in which value isn't null and its percentiles, linear between values, as an array
    in the order of qs. Groups of any size; a group without a value has no row."""
    counts = ordered_counts(df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double")), by, value)
    place = [F.lit(q) * (F.col("rows") - 1) for q in qs]
    ranks = F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil)))
    picked = counts.filter(F.exists(ranks, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))))
    got = picked.groupBy(*by).agg(F.max("rows").alias("rows"), F.collect_list(F.struct("before", "n", value)).alias("__v"))
    at = lambda k: F.element_at(F.filter("__v", lambda v: (k >= v["before"]) & (k < v["before"] + v["n"])), 1)[value]

    def between(q: float) -> Column:
        p = F.lit(q) * (F.col("rows") - 1)
        low, high = at(F.floor(p).cast("long")), at(F.ceil(p).cast("long"))
        return low + (high - low) * (p - F.floor(p))

    out = got.select(*by, "rows", F.array(*map(between, qs)).alias("q"))
    return out if by else out.filter("rows IS NOT NULL")
