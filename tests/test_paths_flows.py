"""Text forms of geometry, and the flow chart."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.functions import generators, layouts, paths, scores
from graphmill.operators import corpus, flows, properties
from graphmill.sources import formats


@pytest.mark.parametrize("path", ["M 10,20 L 30,40", "M 10 20 C 1 2 3 4 50 60 S 7 8 9 9", "M10,20h5v-3l2,2", "m 10 20 q 1 1 2 2 t 3 3", "M 1e1,2E1 A 5 5 0 0 1 20 30 L 4 4"])
def test_moved_paths(path):
    centre, scale = (10.0, 20.0), 2.5
    want = (scores.polyline(path) - centre) * scale
    got = scores.polyline(paths.moved_path(path, centre, scale))
    assert np.allclose(want, got, atol=1e-3)
    assert [c for c in paths.moved_path(path, centre, scale) if c.isalpha() and c != "e"] == [c for c in path if c.isalpha() and c not in "eE"]


def test_snapped_paths():
    assert paths.snapped_path("M 1,2 C 3 4 5 6 7 8", (0, 0), (9, 9)) == "M 0,0 C 3 4 5 6 9,9"
    assert paths.snapped_path("M 1 2 l 5 5", (0, 0), (9, 9)) == "M 0,0 l 5 5"


def test_splines_and_tglf():
    assert paths.spline_points("e,9,9 s,1,1 2,2 3,3") == [(1, 1), (2, 2), (3, 3), (9, 9)]
    assert paths.without_anchors([(0, 0), (1, 1), (2, 2.0005)], (0, 0), (2, 2)) == [(1, 1)]
    text = paths.to_tglf([(15, 15), (15, 15)], [(0, 1)], [(1, 2), (5, 6)])
    assert text == "0 1 2 15 15\n1 5 6 15 15\n#\n0 1\n"
    assert paths.from_tglf("0 1 2 15 15\n1 5 6 15 15\n#\n0 1 1 2 3 3 5 6\n") == ({0: (1, 2), 1: (5, 6)}, {(0, 1): [(3, 3)]})


def test_documents_round_trip():
    n, us, vs = dict(generators.calibration())["petersen"]
    xy = [(float(i), float(i * i)) for i in range(n)]
    lines = ["M 0,0 L 1,1" if i == 3 else None for i in range(len(us))]
    for fmt, text in (("graphml", paths.to_graphml(n, us, vs, xy, lines)), ("geg", paths.to_geg(n, us.tolist(), vs.tolist(), xy, lines))):
        raw = next(formats.PARSERS[fmt]("x", text.encode()))
        if fmt == "graphml":
            raw.nodes = [int(x) for x in raw.nodes]
        got = formats.canonical(raw, True)
        assert (got["n"], len(got["us"]), sum(p is not None for p in got["paths"])) == (n, len(us), 1) and sorted(got["xs"]) == [x for x, _ in xy]


def test_circle_with_fewer_crossings():
    for name in ("grid_3x4", "W_7", "Q_3", "bin_tree_h3"):
        g = dict(generators.calibration())[name]
        plain, sifted = (scores.score(*g, layouts.lay_out(k, *g)[0])["edge_crossings"] for k in ("circular", "baur-brandes"))
        assert sifted >= plain
    assert scores.score(*g, layouts.lay_out("baur-brandes", *g)[0])["edge_crossings"] == 1.0  # a tree


def test_bands_and_columns(spark):
    links = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 1.0)], "source string, target string, value double")
    got = {(r.source, r.target): (r.source_from, r.source_to, r.target_from, r.target_to) for r in flows.link_bands(links, F.lit(8.0)).collect()}
    assert got == {("a", "x"): (0, 2, 0, 4), ("a", "y"): (2, 8, 0, 8), ("b", "x"): (0, 8, 4, 8)}
    boxes = spark.createDataFrame([(0, "p", 0.0, 10.0), (0, "q", 5.0, 10.0), (0, "r", 30.0, 10.0), (1, "s", 50.0, 5.0)], "column int, name string, y double, height double")
    at = {r.name: r.y for r in flows.stacked(boxes, 2.0, 36.0).collect()}
    assert at == {"p": 0, "q": 12, "r": 26, "s": 31}
    assert flows.chart_svg(flows.stacked(boxes, 2.0).withColumn("name", F.translate("name", "pqrs", "abxy")), flows.link_bands(links, F.lit(8.0))).count("<path") == 3


def test_shares_boundaries_summary(spark):
    shares = spark.createDataFrame([("m", "cluster", 0.2), ("m", "cluster", 0.3), ("m", "layout", 0.1), ("m", "residual", 0.4)], "metric string, kind string, share double")
    assert tuple(flows.cluster_share(shares).first()) == ("m", 0.5, 0.1, 0.4)
    ordered = spark.createDataFrame([(0, 1), (1, 1), (2, 5)], "k int, c int")
    assert [r.new for r in flows.boundaries(ordered, "k", "c").orderBy("k").collect()] == [False, False, True]
    text = flows.summary(spark.createDataFrame([("real_world", "s", 3)], "category string, source string, n int"), spark.createDataFrame([("circular", 2)], "layout string, n int"), spark.createDataFrame([("no_edges", 1)], "reason string, n int"))
    assert json.loads(text) == {"cohorts": {"real_world": {"s": 3}}, "drawings": {"circular": 2}, "rejected": {"no_edges": 1}, "total_drawings": 2}


def test_timings(spark):
    g = dict(generators.calibration())["petersen"]
    packed = spark.createDataFrame([("p", g[0], g[1].tolist(), g[2].tolist())], "graph_id string, n int, us array<int>, vs array<int>")
    got = properties.timings(packed).collect()
    assert {r.property for r in got} == set(properties.TIMED) and all(r.seconds >= 0 and r.n_edges == 15 for r in got)
    assert corpus.per_graph(packed, lambda n, us, vs: 1 / 0, "x int").first().x is None
