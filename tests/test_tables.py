"""Corpus relations, joins, upkeep and statistics against plain Python and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphmill import scale, seeds
from graphmill.functions import generators, layouts, scores
from graphmill.operators import analysis, corpus, drawings, isomorphism, properties, scoring, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def as_edges(spark, graphs):
    return spark.createDataFrame([(k, int(u), int(v)) for k, (_, us, vs) in graphs.items() for u, v in zip(us, vs, strict=True)], "graph_id string, u long, v long")


@pytest.fixture(scope="module")
def named(spark):
    return {k: g for k, g in generators.calibration() if k in ("petersen", "K_5", "K_3_3", "C_7", "star_5", "grid_3x4", "W_7", "Q_3")}


def test_skew_join_equals_join(spark, monkeypatch):
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(600)] + [(None, -1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, x int")
    for how in ("inner", "left"):
        want = rows(left.join(right, "k", how))
        monkeypatch.setattr(scale, "HOT_ROWS", 50)
        assert rows(scale.skew_join(left, right, ["k"], how)) == want
        monkeypatch.setattr(scale, "HOT_ROWS", 200_000)
    many = right.unionByName(right.withColumn("x", F.col("x") + 10)).unionByName(spark.createDataFrame([("k7", i) for i in range(300)], "k string, x int"))
    want, turned = rows(left.join(many, "k")), rows(many.join(left, "k"))
    monkeypatch.setattr(scale, "HOT_ROWS", 50)
    assert rows(scale.salted_join(left, many, ["k"])) == want and rows(scale.salted_join(many, left, ["k"])) == turned
    assert scale.hot_keys(left, ["k"]).collect()[0][0] == "hot"


def test_hashed_rank_is_a_rank(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else str(i % 4), i) for i in range(200)], "g string, i int").withColumn("h", F.md5(F.col("i").cast("string")))
    got = scale.hashed_rank(df, ["g"], "h", "r", 1).toPandas()
    want = got.groupby("g", dropna=False)["h"].rank().astype(int)
    assert (got["r"] == want).all() and len(got) == 200


def test_seeds_agree(spark):
    got = spark.createDataFrame([("g1",)], "g string").select(seeds.seed_column(7, "layout", F.col("g"))).first()[0]
    assert got == seeds.seed(7, "layout", "g1")


def test_native_and_kernel_invariants_agree(spark, named):
    e = as_edges(spark, named)
    kernel = {r.graph_id: r for r in properties.manifest24(corpus.pack(e)).collect()}
    for df in (properties.degree_stats(e), properties.clustering(e), properties.assortativity(e), corpus.size_density(e)):
        for r in df.collect():
            for c in set(df.columns) & set(properties.NAMES):
                a, b = r[c], kernel[r.graph_id][c]
                assert a is None and b is None or abs(a - b) < 1e-9, (r.graph_id, c)
    assert rows(corpus.unpack(corpus.pack(e)).groupBy("graph_id").count()) == rows(e.groupBy("graph_id").count())


def test_native_and_kernel_scores_agree(spark, named):
    e = as_edges(spark, named)
    at = drawings.random(corpus.degrees(e).select("graph_id", "node"))
    kernel = {r.graph_id: r for r in scoring.scored(e, at).collect()}
    parts = [drawings.aspect_ratio(at), drawings.node_resolution(at), drawings.node_uniformity(at), *(f(e, at) for f in (drawings.edge_length_deviation, drawings.edge_orthogonality, drawings.angular_resolution, drawings.crossing_scores, drawings.gabriel_ratio, drawings.node_edge_occlusion, drawings.neighbourhood_preservation))]
    seen = set()
    for df in parts:
        for r in df.collect():
            for c in set(df.columns) & set(scores.NAMES):
                seen.add(c)
                assert abs(r[c] - kernel[r.graph_id][c]) < 1e-9, (r.graph_id, c)
    assert seen == set(scores.NAMES) - {"kruskal_stress"}


def test_fused_pass_skips_what_is_done_or_ruled_out(spark, named):
    packed = corpus.pack(as_edges(spark, named))
    flagged = packed.join(properties.manifest24(packed).select("graph_id", "is_planar", "is_tree"), "graph_id")
    done = spark.createDataFrame([("K_5", "circular")], "graph_id string, layout string")
    got = scoring.laid_out_and_scored(flagged, ["circular", "planar", "radial-tree"], done=done, flags=True).toPandas()
    assert set(got[got.layout == "circular"].graph_id) == set(named) - {"K_5"}
    assert set(got[got.layout == "radial-tree"].graph_id) == {"star_5"} and not set(got[got.layout == "planar"].graph_id) & {"K_5", "K_3_3", "petersen"}
    again = scoring.laid_out_and_scored(flagged.repartition(1), ["circular", "planar", "radial-tree"], done=done, flags=True).toPandas()
    key = ["graph_id", "layout"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))


def test_canonical_edges(spark):
    df = spark.createDataFrame([(1, "b", "a"), (1, "a", "b"), (1, "a", "a"), (1, "10", "9"), (2, "x", "x"), (1, None, "a"), (1, "9", "a")], "g int, s string, t string")
    assert rows(corpus.canonical_edges(df, "g", "s", "t")) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_reasons_in_order(spark):
    df = spark.createDataFrame([(7, 6, True), (8, 7, True), (75, 80, True), (76, 80, True), (10, 5, False), (9, 0, False), (16, 100, True), (200, 0, False)], "n int, m int, c boolean")
    got = [r[0] for r in df.select(corpus.reject_reason(F.col("n"), F.col("m"), F.col("c"))).collect()]
    assert got == ["out_of_size", None, None, "out_of_size", "disconnected", "no_edges", "over_density_cap", "out_of_size"]


def test_caps(spark):
    df = spark.createDataFrame([("s", i) for i in range(9)] + [("t", 1)], "source string, i int")
    assert corpus.first_accepted(df, ["source"], [F.col("i")], 2).count() == 3
    assert corpus.first_accepted(df, ["source"], [F.col("i")], 0).count() == 10
    assert corpus.first_accepted(df, ["source"], [F.col("i")], F.lit(2)).count() == 3
    caps = F.when(F.col("source") == "s", 4)  # none for t
    assert rows(corpus.first_accepted(df.withColumn("__x", F.lit(1)), ["source"], [F.desc("i")], caps).select("source", "i")) == [("s", 5), ("s", 6), ("s", 7), ("s", 8), ("t", 1)]
    assert corpus.first_accepted(df, ["source"], [F.col("i")], F.lit(None).cast("int")).count() == 10


def test_isomorphism_classes(spark):
    base = {"b": generators.graph(6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]), "a": generators.graph(6, [(i, (i + 1) % 6) for i in range(6)]), "c": generators.graph(6, [(0, 2), (2, 4), (4, 1), (1, 3), (3, 5), (5, 0)]), "d": generators.graph(5, [(0, 1), (1, 2), (2, 3), (3, 4)])}
    got = dict(rows(isomorphism.isomorphism_classes(corpus.pack(as_edges(spark, base)))))
    assert got == {"a": "a", "b": "b", "c": "a", "d": "d"}
    assert isomorphism.isomorphism_classes(corpus.pack(as_edges(spark, {"d": base["d"]}).limit(0))).count() == 0


def test_upkeep(spark):
    df = spark.createDataFrame([("g1", 1, 0.1), ("g1", 3, 0.3), ("g1", 2, 0.2), ("lost", 1, 0.5)], "graph_id string, seq int, x double")
    manifest = spark.createDataFrame([("g1",), ("g2",), (None,)], "graph_id string")
    clean = tables.last_writes(tables.without_orphans(df, manifest), ["graph_id"], [F.desc("seq")])
    assert rows(clean) == [("g1", 3, 0.3)] and rows(tables.last_writes(clean, ["graph_id"], [F.desc("seq")])) == rows(clean)
    assert {r[0] for r in tables.known_ids((df, "graph_id"), (manifest, "graph_id")).collect()} == {"g1", "g2", "lost"}
    assert tables.last_writes(df.limit(0), ["graph_id"], [F.desc("seq")]).count() == 0


def test_sample_of_one_source_ignores_others(spark):
    pdf = pd.DataFrame([(f"s{s}_{i}", f"S{s}", 10 + (i * 7 + s) % 60, 0.05 + (i % 40) / 100) for s in range(3) for i in range(100)], columns=["graph_id", "source", "n_nodes", "density"])
    whole = tables.stratified_sample(spark.createDataFrame(pdf), 30).toPandas()
    part = tables.stratified_sample(spark.createDataFrame(pdf[pdf.source != "S2"]).repartition(5), 30).toPandas()
    assert whole.groupby("source").size().to_dict() == {"S0": 30, "S1": 30, "S2": 30}
    assert set(whole[whole.source != "S2"].graph_id) == set(part.graph_id)


def test_strata_equal_pandas(spark):
    r = np.random.default_rng(0)
    pdf = pd.DataFrame({"graph_id": [str(i) for i in range(300)], "source": "s", "n_nodes": r.integers(5, 25, 300), "density": np.round(r.random(300), 2)})
    got = tables.strata(spark.createDataFrame(pdf)).toPandas().set_index("graph_id").stratum
    a, b = (pd.qcut(pdf[c], 5, labels=False, duplicates="drop").astype(str) for c in ("n_nodes", "density"))
    assert (got.loc[pdf.graph_id].values == (a + "_" + b).values).all()


def test_strata_and_sample_keep_null_sources(spark):
    rows = [(f"g{i}", "a" if i % 3 else None, 5 + i % 20, None if i % 10 == 0 else i / 100, "x") for i in range(90)]
    df = spark.createDataFrame(rows, "graph_id string, source string, n_nodes int, density double, stratum0 string")
    assert tables.strata(df).count() == 90
    got = tables.stratified_sample(df, 7).toPandas()
    assert got.groupby(got.source.fillna("")).size().to_dict() == {"": 7, "a": 7}
    by_name = tables.stratified_sample(df, {"a": 9, "zzz": 1}).toPandas()
    assert by_name.groupby(by_name.source.fillna("")).size().to_dict() == {"": 30, "a": 9}
    assert tables.stratified_sample(df, 0).count() == tables.stratified_sample(df, {}).count() == 90
    assert tables.stratified_sample(df.limit(0), 5).count() == 0


@pytest.mark.parametrize(("counts", "cap"), [({"a": 100, "b": 1, "c": 1}, 10), ({"a": 5, "b": 5}, 7), ({"a": 3, "b": 3, "c": 3}, 2), ({"a": 50, "b": 50, "c": 50}, 100), ({f"s{i:02d}": 1 + i for i in range(25)}, 30), ({f"s{i:02d}": 400 - i for i in range(25)}, 2500)])
def test_allocation(spark, counts, cap):
    df = spark.createDataFrame([(None, k, n) for k, n in counts.items()] + [("other", "a", 3)], "source string, stratum string, n long")
    found = tables.allotment(df, "source", F.lit(cap)).collect()
    got = {r.stratum: r.quota for r in found if r.source is None}
    assert sum(got.values()) == cap and all(0 <= got[k] <= counts[k] for k in counts)
    if cap >= len(counts):
        assert min(got.values()) >= 1 and all(abs(got[k] - counts[k] * cap / sum(counts.values())) <= 1.5 or got[k] == 1 for k in counts if cap > 100)
    assert [r.quota for r in found if r.source] == [min(3, cap)]


def test_counts_in_order(spark):
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": [["a", "b", None][i % 3] for i in range(900)], "v": np.where(r.random(900) < 0.4, 1.5, np.round(r.normal(0, 1, 900), 2))})
    df = spark.createDataFrame(pdf, "g string, v double")
    got = {(x.g, x.v): (x.n, x.before) for x in scale.ordered_counts(df.repartition(6), ["g"], "v").collect()}
    for (g, v), (n, before) in got.items():
        own = pdf.v[pdf.g == g] if g else pdf.v[pdf.g.isna()]
        assert n == (own == v).sum() and before == (own < v).sum()
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for x in scale.exact_percentiles(df.unionByName(df.limit(3).withColumn("v", F.lit(None).cast("double"))), ["g"], "v", qs).collect():
        own = pdf.v[pdf.g == x.g] if x.g else pdf.v[pdf.g.isna()]
        assert x.rows == len(own) and np.allclose(x.q, np.quantile(own, qs))
    whole = scale.exact_percentiles(df, [], "v", qs).collect()
    assert np.allclose(whole[0].q, np.quantile(pdf.v, qs)) and scale.exact_percentiles(df.limit(0), ["g"], "v", qs).count() == 0


def test_duplicates_protect_and_report(spark):
    df = spark.createDataFrame([("z", "s", "real_world", 5, 2, 3), ("y", "s", "real_world", 5, 2, 3), ("x", "d", "graphs_with_drawings", 5, 0, 1), ("w", None, "graphs_with_drawings", 5, 0, 1), ("v", "s", "real_world", None, 2, 3), ("u", "s", "real_world", None, 2, 3)], "graph_id string, source string, category string, k int, tier int, size int")
    audit = tables.dedup_audit(tables.duplicates(df, ["k"], [F.col("tier"), F.col("size"), F.col("graph_id")]))
    assert sorted((r.dropped_graph_id, r.kept_graph_id, r.iso_class_size, r.scope) for r in audit.collect()) == [("v", "u", 2, "within-source"), ("y", "w", 4, "cross-source"), ("z", "w", 4, "cross-source")]


def test_spearman_equals_pandas(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": r.integers(0, 8, 200).astype(float), "b": r.random(200), "c": r.random(200)})
    pdf["d"] = pdf.a + pdf.b
    pdf.loc[::7, "b"] = np.nan
    got = {(x.x, x.y): x for x in analysis.spearman(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double"), ["a", "c"], ["b", "d"]).collect()}
    for (x, y), v in got.items():
        both = pdf[[x, y]].dropna()
        assert v.n == len(both) and abs(v.rho - both.rank().corr().iloc[0, 1]) < 1e-9
    assert len(got) == 4


def test_bins_equal_pandas(spark):
    x = np.array([1, 1, 1, 1, 2, 3, 4, 5, 9, 9] * 12, float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.arange(120.0)}))
    for q, cut in ((True, pd.qcut(x, 5, labels=False, duplicates="drop")), (False, pd.cut(x, 5, labels=False))):
        got = {r.bin: r.n for r in analysis.binned(df, ["x"], ["y"], [5], q).collect()}
        assert got == {int(k): int(v) for k, v in zip(*np.unique(cut, return_counts=True), strict=True) if v >= 10}
    assert analysis.binned(df.limit(50), ["x"], ["y"], [5], True).count() == 0


def test_variance_shares(spark):
    df = spark.createDataFrame([(g, lay, float(g * 2 + lay), 1.0) for g in range(5) for lay in range(3)], "g int, l int, y double, z double")
    got = {(r.metric, r.factor): r.share for r in analysis.sequential_variance(df, ["y", "z"], ["g", "l"]).collect()}
    assert abs(got["y", "residual"]) < 1e-9 and abs(sum(got["y", f] for f in ("g", "l", "residual")) - 1) < 1e-9 and got["z", "g"] is None


def test_shapley_adds_up(spark):
    r = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": r.random(300), "b": r.random(300), "l": r.choice(["p", "q"], 300)})
    pdf["y"] = 2 * pdf.a + (pdf.l == "p") + 0.1 * r.random(300)
    got = dict(analysis.shapley_r2(spark.createDataFrame(pdf), "y", {"a": ["a"], "b": ["b"]}, layout="l"))
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] > got["layout"] > 10 * abs(got["b"]) and got["residual"] < 0.02


def test_prefixes(spark):
    ids = spark.createDataFrame([("A_b_graph1.graphml",), ("A_b_c_x.geg",), ("A_bx_1.geg",), ("plain.geg",), (None,)], "graph_id string")
    sources = spark.createDataFrame([("A/b",), ("A/b/c",), ("A",), (None,)], "source string")
    assert [r.source for r in analysis.prefix_source(ids, sources).orderBy("graph_id").collect()] == ["unknown", "A/b/c", "A/b", "A", "unknown"]


def test_flags_and_paths(spark):
    df = spark.createDataFrame([("a", "M 0 0 L 1 1 L 2 2"), ("a", None), ("b", "M 1e-5,0 L 2,1"), ("c", "m 0 0 q 1 1 2 2")], "g string, path string")
    assert rows(drawings.path_flags(df, ["g"])) == [("a", True, False), ("b", False, False), ("c", False, True)]
    p = spark.range(1).select(F.expr("named_struct('x', 0D, 'y', 0D)").alias("s"), F.expr("array(named_struct('x', 70D, 'y', 40D), named_struct('x', 30D, 'y', 40D))").alias("b"), F.expr("named_struct('x', 100D, 'y', 0D)").alias("e"))
    assert p.select(drawings.bends_path(F.col("s"), drawings.oriented_bends(F.col("s"), F.col("b")), F.col("e"))).first()[0] == "M 0.00000,0.00000 L 30.0000,40.0000 L 70.0000,40.0000 L 100.000,0.00000"


def test_standard_form_is_idempotent(spark):
    at = spark.createDataFrame([("g", "l", i, float(i * i), float(i)) for i in range(5)] + [("h", "l", 0, 3.0, 4.0)], "graph_id string, layout string, node long, x double, y double")
    once = drawings.standardise(at)
    a, b = (x.orderBy("graph_id", "node").toPandas() for x in (once, drawings.standardise(once)))
    assert np.allclose(a[["x", "y"]], b[["x", "y"]]) and np.allclose(a.iloc[-1][["x", "y"]].astype(float), 0)


def test_random_places_are_the_same_in_columns_and_kernel(spark):
    g = generators.graph(6, [(i, (i + 1) % 6) for i in range(6)])
    at = {r.node: (r.x, r.y) for r in drawings.random(spark.createDataFrame([("g1", i) for i in range(6)], "graph_id string, node long"), root=5).collect()}
    xy, _ = layouts.lay_out("random", *g, seed=seeds.seed(5, "random", "g1"))
    assert np.allclose(xy, [at[i] for i in range(6)])


def test_registered_metrics(spark, named):
    e = as_edges(spark, {k: named[k] for k in ("petersen", "K_5")})
    at = drawings.circular(corpus.degrees(e).select("graph_id", "node"))
    got = drawings.measured(e, at, sorted(drawings.METRICS)).toPandas().set_index("graph_id")
    for k in ("petersen", "K_5"):
        want = scores.score(*named[k], layouts.lay_out("circular", *named[k])[0])
        assert all(abs(got.loc[k, m] - want[m]) < 1e-6 for m in drawings.METRICS), k
    with pytest.raises(ValueError, match="exists"):
        drawings.register_metric("aspect_ratio", drawings.METRICS["aspect_ratio"])


def test_titles_of_clusters():
    found = [("n_nodes", 1, 0), ("n_edges", 1, 1), ("diameter", 2, 2), ("radius", 2, 3), ("density", 3, 4)]
    assert analysis.representatives(found, analysis.PREFERENCE) == {1: "n_edges", 2: "diameter", 3: "density"}
    assert analysis.cluster_titles(found) == {1: "Size (|V|, |E|)", 2: "diameter", 3: "density"}
    assert analysis.with_composites(found)[-2:] == [("quality", 4, 5), ("empirical_quality", 5, 6)]


def test_generated_parameters_are_in_range():
    """Ring widths, mean degrees and radii over many draws."""
    widths, means, dense = set(), [], []
    for seed in range(300):
        r = np.random.default_rng(seed)
        n, us, vs = generators.FAMILIES["nws"].make(r, 13)
        deg = np.bincount(np.concatenate((us, vs)), minlength=n)
        widths.add(int(deg.min()))
        n, us, _ = generators.FAMILIES["lfr"].make(np.random.default_rng(seed), 60)
        means.append(2 * len(us) / n)
        n, us, _ = generators.FAMILIES["geo"].make(np.random.default_rng(seed), 40)
        dense.append(2 * len(us) / (n * (n - 1)))
    assert {2, 4} <= widths and 3.0 < np.mean(means) < 7.5 and 0.1 < np.mean(dense) < 0.5
