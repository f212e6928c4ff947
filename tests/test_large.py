"""Work on many graphs: what is held in memory at once, and batches against single graphs."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest

from graphmill.functions import batches, generators, kernels, scores
from graphmill.operators import corpus, scoring
from graphmill.plans import q_corpus, q_sources
from graphmill.plans.q_drawings import FUSED
from graphmill.sources import readers, writers


@pytest.mark.parametrize("fmt", ["gpml", "csv_zip", "matrix_market"])
def test_files_are_parsed_in_the_task_that_writes_them(spark, fmt):
    packed = spark.createDataFrame([(i, 3, [0, 0, 1], [1, 2, 2]) for i in range(5)], "graph_id long, n int, us array<int>, vs array<int>")
    got = q_sources.read_back(packed, fmt)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert sorted(got.collect()) == [(str(i), u, v) for i in range(5) for u, v in ((0, 1), (0, 2), (1, 2))]


def test_no_more_than_a_block_is_parsed_at_once(monkeypatch):
    monkeypatch.setattr(readers, "BLOCK", 20)
    asked = []

    def contents():
        for i in range(50):
            asked.append(i)
            yield f"{i}.dat", b"broken" if i == 7 else writers.WRITERS["gpml"](str(i), 3, [0, 1], [1, 2])

    blocks = readers.parsed(contents(), "gpml", True, ["path", "us", "problem"])
    first = next(blocks)
    assert len(first) == 4 and len(asked) == 4
    rows = [first, *blocks]
    assert [p for b in rows for p in b.path] == [f"{i}.dat" for i in range(50)] and max(map(len, rows)) <= 5
    assert [(p, why) for b in rows for p, why in zip(b.path, b.problem, strict=True) if why] == [("7.dat", "parse_error")]


def corpus_of(seed, sizes):
    r, out = np.random.default_rng(seed), []
    for k, n in enumerate(sizes):
        i, j = np.triu_indices(n, 1)
        c = np.sort(r.choice(len(i), int(r.integers(1, len(i) + 1)), replace=False))
        out.append((k, n, i[c].tolist(), j[c].tolist()))
    return [*out, *((100 + k, g[0], g[1].tolist(), g[2].tolist()) for k, (_, g) in enumerate(generators.calibration()) if g[0] < 20)]


ALL = ["circular", "random", "spectral", "arc-bfs", "stress-majorization", "pivot-mds", "radial-tree", "kamada-kawai", "forceatlas2", "fruchterman-reingold", "planar", "sugiyama", "baur-brandes"]


def test_batches_equal_single_graphs(spark):
    graphs = [*corpus_of(3, [2, 3, 4, 9, 9, 9, 9, 14, 14, 14]), (90, 1, [], []), (91, 3, [0, 1], [0, 2]), (92, 6, [0, 1, 3], [1, 2, 4])]
    packed = spark.createDataFrame(graphs, "graph_id long, n int, us array<int>, vs array<int>")
    got = {(r.graph_id, r.layout): r.asDict() for r in scoring.laid_out_and_scored(packed, ALL).collect()}
    assert len(got) == len(graphs) * len(ALL)
    for g, n, us, vs in graphs:
        for layout in ALL:
            want, have = scoring.one_drawing(layout, g, n, np.array(us, np.int64), np.array(vs, np.int64)), got[g, layout]
            for c in ("outcome", *scores.FLAGS):
                assert have[c] == want.get(c), (g, layout, c)
            for c in scores.NAMES:
                near = want.get(c) if want.get(c) is None else pytest.approx(want[c], abs=1e-6)
                assert have[c] == near, (g, layout, c)


def test_graphs_of_one_size_share_a_call(spark, monkeypatch):
    called = []
    monkeypatch.setattr(batches, "scores", lambda c, xy, lines=None, f=batches.scores: called.append(c.size) or f(c, xy, lines))
    rows = [SimpleNamespace(graph_id=k, n=n, us=us, vs=vs, open=("circular", "arc-bfs")) for k, n, us, vs in corpus_of(4, [9] * 40)[:40]]
    parts = list(scoring._chunks(rows))
    assert len(parts) == 1 and len(scoring._scored_chunk(*parts[0], "arc-bfs", 1)) == 40 and called == [40]


def isotonic(y):
    blocks = []
    for v in y:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            s, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + k]
    return [s / k for s, k in blocks for _ in range(k)]


@pytest.mark.parametrize("seed", range(20))
def test_isotonic_equals_pooling_one_by_one(seed):
    r = np.random.default_rng(seed)
    y = np.concatenate([np.sort(r.integers(0, 30, int(r.integers(1, 40))) / 7) for _ in range(seed % 5 + 1)])
    assert kernels.isotonic(y).tolist() == isotonic(y.tolist())


def test_layout_bounds_takes_a_graphs_layouts_together(spark, tmp_path):
    spark.createDataFrame([(o, p) for o in range(30) for p in (o, o + 1, o + 3, 31)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o // 2) for o in range(30)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    df = q_sources.layout_bounds(spark, str(tmp_path))
    assert "explode(__open" not in df._jdf.queryExecution().optimizedPlan().toString()  # a graph's layouts reach the task together
    got = {r.layout: r for r in df.collect()}
    assert set(got) == set(FUSED) and all((r.n_graphs, r.within_bounds, r.circle_fits) == (15, True, True) for r in got.values())


def test_graphs_of_one_row_equal_packed_edges(spark, tmp_path):
    r = np.random.default_rng(5)
    lines = [(int(o), None if p % 50 == 0 else int(p)) for o, p in zip(r.integers(0, 300, 1500), r.integers(-90, 90, 1500), strict=True)]
    spark.createDataFrame([*lines, (None, 7), (None, 8)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([*((o, o % 70 if o % 9 else None) for o in range(290)), (3, 3), (3, 65), (None, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = q_corpus.packed(spark, str(tmp_path))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair of nodes is a row
    want = corpus.pack(q_corpus.edges(spark, str(tmp_path))).filter("graph_id IS NOT NULL")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 60
    counts = {r.layout: r.n_graphs for r in q_sources.layout_bounds(spark, str(tmp_path)).collect()}
    assert counts == dict.fromkeys(FUSED, want.count())


@pytest.mark.parametrize("n", [3, 9, 17, 30])
def test_arcs_that_are_looked_up_equal_their_points(n, monkeypatch):
    graphs = [(np.array(us), np.array(vs)) for k, size, us, vs in corpus_of(n, [n] * 12) if k < 100]
    c = batches.Chunk(n, graphs)
    got = batches.scores(c, *batches.arc_bfs(c))
    monkeypatch.setattr(batches, "ARCS", 0)
    assert batches.arc_bfs(c)[1].shape[1:] == (10, 2)
    want = batches.scores(c, *batches.arc_bfs(c))
    for name in scores.NAMES:
        np.testing.assert_allclose(got[name], want[name], atol=1e-9, err_msg=name)


@pytest.mark.parametrize("seed", range(10))
def test_pooled_equals_isotonic(seed):
    r = np.random.default_rng(seed)
    hops = np.sort(r.integers(1, 2 + seed % 5, (20, 45)), axis=1)
    dist = np.round(r.random((20, 45)), 1) if seed % 2 else r.random((20, 45))
    dist = dist[np.arange(20)[:, None], np.lexsort((dist, hops), axis=1)]
    np.testing.assert_allclose(batches._pooled(dist, hops), [kernels.isotonic(x) for x in dist], atol=1e-9)
