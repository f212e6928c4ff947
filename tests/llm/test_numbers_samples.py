"""Problems 3, 4 and 5."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphmill.llm import blocks, quantiles, quotas

QS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def off(values, q, guess):
    """By how many ranks guess misses the value at q."""
    s = np.sort(values)
    rank = math.floor(q * (len(s) - 1))
    lo, hi = np.searchsorted(s, guess, "left"), np.searchsorted(s, guess + abs(guess) * 2.0**-quantiles.MANTISSA, "right") - 1
    return max(0, lo - rank, rank - hi)


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=50))
def test_codes_keep_order(xs):
    x = np.array(xs)
    codes = quantiles.encode(x)
    assert all((codes[i] <= codes[j]) for i in range(len(x)) for j in range(len(x)) if x[i] <= x[j])
    with np.errstate(invalid="ignore"):
        fine = np.isfinite(x) & (np.abs(x) > 1e-300) & (np.abs(x) < 1e300)
        assert (np.abs(quantiles.decode(codes) - x)[fine] <= np.abs(x)[fine] * 2.0**-quantiles.MANTISSA).all()


def test_whole_numbers_are_exact():
    x = np.arange(0, 20_000, dtype=float)
    assert (quantiles.decode(quantiles.encode(x)) == x).all()


def shapes(n=60_000, seed=3):
    r = np.random.default_rng(seed)
    return {"even": r.random(n), "normal": r.normal(0, 5, n), "ties": np.where(r.random(n) < 0.4, 1.0, r.beta(2, 5, n)), "skewed": r.pareto(1.2, n), "one": np.full(n, 0.25), "ints": r.integers(2, 80, n).astype(float)}


def test_rank_error_of_counters():
    for name, x in shapes().items():
        s = quantiles.Sketch()
        s.add(quantiles.encode(x), np.ones(len(x), np.int64))
        n, got = s.quantiles(QS)
        assert n == len(x)
        assert all(off(x, q, g) <= quantiles.RANK_ERROR * n for q, g in zip(QS, got, strict=True)), (name, got)


def test_rank_error_of_ties():
    """100 draws each of few and of many different values, evenly and unevenly repeated, all 101 percentiles."""
    qs = [i / 100 for i in range(101)]
    for k in (2, 10, 50, 100, 200, 1000, 5000):
        for seed in range(100 if k < 1000 else 20):
            r = np.random.default_rng(1000 * k + seed)
            x = np.unique(r.random(k) if seed % 2 else r.normal(0, 1e4, k))
            w = np.full(len(x), 60_000 // k) if seed % 4 < 2 else (60_000 / r.permutation(np.arange(1, len(x) + 1))).astype(np.int64) + 1
            s = quantiles.Sketch()
            s.add(quantiles.encode(x), w)
            n, got = s.quantiles(qs)
            below = np.append(0, np.cumsum(w))
            for q, g in zip(qs, got, strict=True):
                rank = math.floor(q * (n - 1))
                lo, hi = below[np.searchsorted(x, g, "left")], below[np.searchsorted(x, g + abs(g) * 2.0**-quantiles.MANTISSA, "right")] - 1
                assert max(0, lo - rank, rank - hi) <= quantiles.RANK_ERROR * n, (k, seed, q)


def test_sizes_follow_from_the_error():
    t = quantiles.RANK_ERROR / quantiles.LEVELS
    assert quantiles.WIDTH >= 8 / t and quantiles.WIDTH == 1 << (quantiles.WIDTH.bit_length() - 1)
    beyond = math.comb(quantiles.DEPTH, (quantiles.DEPTH + 1) // 2) * 16.0 ** -((quantiles.DEPTH + 1) // 2)
    assert quantiles.DEPTH % 2 and 2 * quantiles.LEVELS * beyond <= quantiles.FAILURE
    assert quantiles.ROWS * quantiles.WIDTH.bit_length() <= 64


def test_counters_travel(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "PAIRS", 100)
    x = np.random.default_rng(4).normal(0, 1, 30_000)
    parts = [quantiles.Sketch() for _ in range(3)]
    for i, s in enumerate(parts):
        s.add(quantiles.encode(x[i::3]), np.ones(len(x[i::3]), np.int64))
    assert all(s.state()[:1] == b"i" for s in parts)
    whole = quantiles.Sketch()
    for s in parts:
        whole.merge(s.state())
    n, got = whole.quantiles(QS)
    assert n == len(x) and all(off(x, q, g) <= quantiles.RANK_ERROR * n for q, g in zip(QS, got, strict=True))


def test_parts_add_up_and_deletions_undo():
    x = np.random.default_rng(1).random(50_000)
    whole, halves, undone = quantiles.Sketch(), quantiles.Sketch(), quantiles.Sketch()
    whole.add(quantiles.encode(x), np.ones(len(x), np.int64))
    for part in (x[:20], x[20:]):
        s = quantiles.Sketch()
        s.add(quantiles.encode(part), np.ones(len(part), np.int64))
        halves.merge(s.state())
    y = np.append(x, np.full(70_000, 7.0))
    undone.add(quantiles.encode(y), np.ones(len(y), np.int64))
    undone.add(quantiles.encode(y[50_000:]), -np.ones(70_000, np.int64))
    assert whole.quantiles(QS) == halves.quantiles(QS) == undone.quantiles(QS)
    none = quantiles.Sketch()
    none.add(quantiles.encode(np.array([1.0])), np.array([1]))
    none.add(quantiles.encode(np.array([1.0])), np.array([-1]))
    assert none.quantiles([0.5]) == (0, [None])


def test_days_join_in_any_partitioning(spark):
    rows = [(dt.date(2024, 1, 1 + i % 3) if i % 11 else None, "a" if i % 4 else None, float(i % 97) if i % 5 else math.nan, None if i % 7 == 0 else i / 10, "clash") for i in range(3000)]
    df = spark.createDataFrame(rows, "run_day date, layout string, x double, y double, measure string")
    daily = quantiles.sketches(df.repartition(5), ["run_day", "layout"], ["x", "y"])
    joined = quantiles.percentiles(quantiles.merged(daily, ["layout"]), ["layout"], QS).collect()
    direct = quantiles.percentiles(quantiles.sketches(df.coalesce(1), ["layout"], ["x", "y"]), ["layout"], QS).collect()
    assert sorted(joined, key=repr) == sorted(direct, key=repr) and len(joined) == 4
    for r in joined:
        v = np.array([a[2] if r.measure == "x" else a[3] for a in rows if a[1] == r.layout], float)
        v = v[~np.isnan(v)]
        assert r.n == len(v) and all(off(v, q, r[f"p{round(100 * q):02d}"]) <= quantiles.RANK_ERROR * len(v) for q in QS)
    gone = quantiles.percentiles(quantiles.sketches(df.unionByName(df).withColumn("w", F.lit(1)), ["layout"], ["x"], F.lit(0)), ["layout"], QS).collect()
    assert all(r.n == 0 and r.p50 is None for r in gone)
    assert quantiles.percentiles(quantiles.sketches(df.limit(0), ["layout"], ["x"]), ["layout"], QS).count() == 0


MANIFEST = "graph_id string, source string, n_nodes int, density double, run_no int, row_id long, target_id string"
TARGETS = "target_id int, source string, n_lo int, n_hi int, density_lo double, density_hi double, target_share double, floor_rows int, graph_id string"


def corpus(spark, n=400, runs=4, extra=()):
    rows = [(f"g{i}" if i % 50 else None, [" A", "a", "B\t", None, "?"][i % 5], 5 + i % 30, math.nan if i % 37 == 0 else (i % 20) / 20, 1 + i * runs // n, i, "clash") for i in range(n)]
    rows += [("g7", "b", 10, 0.1, runs, n, "clash"), ("g7", "b", 10, 0.1, runs, n + 1, "clash"), *extra]
    return spark.createDataFrame(rows, MANIFEST), rows


def test_quotas(spark):
    df, rows = corpus(spark)
    targets = spark.createDataFrame([
        (1, "a ", 0, 15, 0.0, 0.5, 0.2, 0, "x"), (2, "A", 16, 99, 0.0, 1.01, 0.3, 4, "x"), (3, "b", 0, 15, 0.0, 1.01, 0.5, 0, "x"),
        (4, "b", 200, 300, 0.0, 1.01, 0.0, 9, "x"), (5, "none", 0, 99, 0.0, 1.01, 0.0, 5, "x"), (6, None, 0, 99, 0.0, 1.0, None, None, "x"),
    ], TARGETS)
    report = {r.target_id: r for r in quotas.allotted(df, targets).collect()}
    size = len({r[0] for r in rows if r[0]}) // 20
    assert [report[i].want for i in range(1, 7)] == [math.floor(0.2 * size + 0.5), max(4, math.floor(0.3 * size + 0.5)), math.floor(0.5 * size + 0.5), 9, 5, 0]
    assert {r.target_id for r in quotas.unmet(df, targets).collect()} == {4, 5}
    assert report[4].allotted == report[5].allotted == 0 and report[3].from_cousins == 9 and report[4].to_cousins == 9
    assert report[1].from_others + report[2].from_others + report[3].from_others == 5 == report[5].to_others
    assert all(r.short == r.to_siblings + r.to_cousins + r.to_others + r.unfilled for r in report.values())
    assert sum(r.allotted for r in report.values()) == sum(r.want for r in report.values())
    plan = quotas.unmet(df, targets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= len(quotas.KIN)  # the cases come out of the allotment
    drawn = quotas.sample(df, targets).collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, quotas.sample(df.repartition(7), targets).collect()))
    assert len({r.graph_id for r in drawn}) == len(drawn)
    for i, r in report.items():
        assert sum(d.target_id == i for d in drawn) == r.allotted
    assert quotas.sample(df.limit(0), targets).count() == 0 and quotas.sample(df, targets.limit(0)).count() == 0
    assert quotas.unmet(df.limit(0), targets).count() == 3


def test_kin_of_each_degree(spark):
    """Source a has two ranges of n_nodes with two densities each; b is elsewhere."""
    rows = [(f"g{i}", "a", 10 if i < 100 else 50, 0.1 if i % 2 else 0.6, 1, i, "x") for i in range(200)] + [(f"h{i}", "b", 10, 0.1, 1, 1000 + i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, MANIFEST)
    cells = [(1, "a", 0, 20, 0.0, 0.5, 0.0, 70), (2, "a", 0, 20, 0.5, 1.0, 0.0, 40), (3, "a", 21, 99, 0.0, 0.5, 0.0, 20), (4, "a", 21, 99, 0.5, 1.0, 0.0, 50), (5, "b", 0, 99, 0.0, 1.0, 0.0, 10), (6, "c", 0, 99, 0.0, 1.0, 0.0, 9)]
    report = {r.target_id: r for r in quotas.allotted(df, spark.createDataFrame([(*c, "x") for c in cells], TARGETS)).collect()}
    assert (report[1].to_siblings, report[1].to_cousins, report[1].to_others, report[1].unfilled) == (10, 10, 0, 0)
    assert report[2].from_siblings == 10 and report[3].from_cousins == 10 and report[4].from_cousins == 0
    assert report[6].to_others == 9 == report[3].from_others + report[5].from_others
    huge = spark.createDataFrame([(1, "a", 0, 20, 0.0, 0.5, 0.0, 7000, "x"), (2, "b", 0, 20, 0.5, 1.0, 0.0, 4, "x")], TARGETS)
    report = {r.target_id: r for r in quotas.allotted(df, huge).collect()}
    assert report[1].unfilled == 7000 - 50 and report[2].unfilled == 4 and report[1].allotted == 50


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_every_block_has_its_picks(spark, start):
    got = spark.range(start * 100, start * 100 + 300).filter(blocks.chosen(F.col("id"), "s")).collect()
    assert [sum(r.id // 100 == start + k for r in got) for k in range(3)] == [blocks.PICKS] * 3


def test_sample_is_stable_as_rows_come(spark):
    df, rows = corpus(spark, n=2000, runs=8, extra=[("new", "a", 5, 0.1, None, 1, "x"), ("new2", "a", 5, 0.1, 3, None, "x")])
    for take, cols in ((blocks.stable_sample, ["graph_id"]), (blocks.stable_sample_by_source, ["source", "graph_id"])):
        before = set()
        for run in (2, 5, 8):
            now = {tuple(r) for r in take(df.filter(F.col("run_no") <= run)).select(*cols).collect()}
            assert before <= now and now == {tuple(r) for r in take(df.filter(F.col("run_no") <= run).repartition(9)).select(*cols).collect()}
            before = now
        assert 60 < len(before) < 140 and take(df.limit(0)).count() == 0
